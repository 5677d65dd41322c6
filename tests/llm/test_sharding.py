"""Sharding: exact round trips, tiers, versions and racing commits."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_with_nulls_and_repeats(spark, tmp_path):
    data = [(1, "a", None), (1, "a", None), (None, None, 3.0), (4, "", 1.0), (5, "x" * 100_000, 2.0)] * 7
    docs = spark.createDataFrame(data, "doc_id long, text string, arrival double")
    store = sharding.sharded(docs, fan_in=2)
    assert rows(store.read()) == rows(docs)
    assert len(store.versions()) == 1 and len(store.manifest()["runs"]) < sharding.ARRIVALS
    assert rows(sharding.sharded(docs.where("false")).read()) == []


def test_tiers_versions_and_target_size(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, fan_in=3)
    batch = lambda i: spark.range(2000).select((F.col("id") + 2000 * i).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for i in range(7):
        store.append(batch(i).coalesce(1))
    before = store.manifest()["version"]
    assert store.compact() == 2
    runs = store.manifest()["runs"]
    assert len(runs) == 3 and store.plan() is None
    assert all(size < 3 * 40_000 for r in runs[:2] for _, size in store.files(r))
    assert rows(store.read()) == rows(store.read(before)) and store.read().count() == 14_000
    assert store.read(2).count() == 4000
    assert store.vacuum() > 0 and store.versions() == [before + 2]
    assert store.read().count() == 14_000


def test_racing_commits(spark, tmp_path):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2) for _ in range(2))
    one = spark.range(3).withColumnRenamed("id", "doc_id")
    store.append(one)
    store.append(one)
    raced = []

    def change(m):
        if not raced:
            raced.append(other.append(one)["version"])  # the other commits between reading and renaming
        return m

    assert store.commit(change)["version"] == raced[0] + 1
    assert store.read().count() == 9
    runs = store.plan()
    other.merge(runs)
    with pytest.raises(sharding.Conflict):
        store.merge(runs)
    assert store.read().count() == 9


def test_new_columns_are_kept_and_other_types_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 7)], "doc_id long, text string, extra int"))
    store.append(spark.createDataFrame([("c", 3)], "TEXT string, doc_id long"))
    want = [(1, "a", None), (2, "b", 7), (3, "c", None)]
    assert rows(store.read()) == want
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    store.compact()
    store.vacuum()
    assert rows(store.read()) == want and store.plan() is None


def test_vacuum_spares_runs_that_are_not_committed_yet(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    five = spark.range(5).withColumnRenamed("id", "doc_id")
    store.append(five)
    five.write.parquet(f"{store.root}/data/run-slow")
    five.write.parquet(f"{store.root}/data/run-dead")
    assert store.vacuum() == 0
    store._add("data/run-slow", five.schema)
    assert store.read().count() == 10
    assert store.vacuum(orphan_seconds=-1) == 1 and store.read().count() == 10  # the crashed writer's folder alone
    five.write.parquet(f"{store.root}/data/run-late")
    late = store._run("data/run-late")
    store.vacuum(orphan_seconds=-1)
    with pytest.raises(sharding.Conflict):
        store._check(late)


def test_no_column_name_is_reserved(spark):
    docs = spark.createDataFrame([(1, 5, "x"), (None, 6, "y"), (None, 7, None)], "doc_id long, _arrival int, _ARRIVAL_ string")
    assert rows(sharding.sharded(docs).read()) == rows(docs)


def test_files_and_tiers_of_a_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    store = sharding.sharded(docs, target_bytes=60_000, fan_in=2)
    runs = store.manifest()["runs"]
    assert store.plan() is None and rows(store.read()) == rows(docs)
    tiers = [store.tier(r["bytes"]) for r in runs]
    assert all(tiers.count(t) < 2 for t in tiers if t < store.tier(60_000 * 2**4))
    assert sum(r["files"] for r in runs) < sharding.ARRIVALS * 2 + sum(r["bytes"] for r in runs) / 20_000
