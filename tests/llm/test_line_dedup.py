"""Line dedup against plain Python: batches, levels, edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    last = float("inf")
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), last), last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, **settings):
    found = L.dedup(docs, **settings).select("_doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, found.collect()), key=str) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (4, 3), (7, 2)])
def test_whole_table(spark, sf_small, batches, fan_in):
    check(spark.read.parquet(f"{sf_small}/documents.parquet"), n_batches=batches, fan_in=fan_in)


def test_edge_cases(spark):
    long = "\n".join(f"line number {i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "Hello World!\n\n  hello world!\t\nshort"), (4, "HELLO WORLD!\nshort"), (5, long), (6, long + "\nlast line of six"), (6, long + "\nlast line of six"), (None, "hello world!\nonly without id\nÉCLAIR AU CHOCOLAT"), (None, "only without id"), (9, "\n" * 5), (10, "écLAIR au chocolat\nÉclair au chocolat"), (11, "x\r\nhello world!\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("owner", F.lit(1))
    check(docs, n_batches=3, fan_in=2)
    kept = L.deduplicated_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert L.dedup(docs.where("false")).count() == 0


def test_runs_are_merged_and_hold_each_key_once(spark):
    runs = L.LineRuns(spark, fan_in=2)
    for i in range(5):
        keys = spark.range(i * 50, i * 50 + 100).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(i).cast("long").alias("owner"))
        runs.add(runs.new_keys(keys))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = [r for run in runs.runs() for r in run.collect()]
    assert len(rows) == len({r.h1 for r in rows}) == 300
    assert all(r.owner == max(0, r.h1 // 50 - 1) for r in rows)
    runs.close()


def test_runs_are_read_in_their_order(spark, sf_small):
    """The plan of a batch's anti-joins sorts and deals the batch's keys alone, never a run."""
    keys = L.line_keys(spark.read.parquet(f"{sf_small}/documents.parquet")).groupBy(*L.KEY).agg(F.min("doc_id").alias("owner")).cache()
    with L.LineRuns(spark, fan_in=9) as runs:
        for i in range(3):
            runs.add(keys.where(F.pmod("h1", F.lit(4)) == i))
        with L.sorted_scans(spark):
            found = runs.new_keys(spark.createDataFrame(keys.collect(), keys.schema))
            plan = found._jdf.queryExecution().sparkPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
            assert plan[1].count("Sort ") == 1 and plan[1].count("Exchange hashpartitioning") == 1, plan[1]
            assert found.count() == keys.where(F.pmod("h1", F.lit(4)) == 3).count()


def test_later_arrivals_go_on_from_the_stored_runs(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    root, ends = f"{tmp_path}/runs", [60, 90, 150, 10**9]
    got, low = [], -1
    for end in ends:
        with L.LineRuns(spark, root, fan_in=2) as runs:  # opened anew each time
            part = docs.where(f"doc_id > {low} and doc_id <= {end}")
            got += [tuple(r) for r in L.dedup(part, runs).select("_doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()]
        low = end
    assert sorted(got, key=str) == brute([tuple(r) for r in docs.collect()])
    with L.LineRuns(spark, root, fan_in=2) as one, L.LineRuns(spark, root, fan_in=2) as other:
        rows = spark.createDataFrame([(1, 2, 3)], "h1 long, h2 long, owner long")
        one.add(rows)
        with pytest.raises(RuntimeError):
            other.add(rows)
    assert [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")] == []
