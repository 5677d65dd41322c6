"""Packed blocks, and what is computed from them, against rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, blocks, decode
from tessera.plans import catalog


def test_blocks_give_back_their_columns():
    g = np.array([3, 3, 5, 9, 9, 9], np.int64)
    doc, sizes = np.array([1, -7, 1 << 62, 4, 4, 5], np.int64), np.array([2, 0, 1, 3, 0, 1], np.int64)
    values = np.array([5, 6, 1 << 40, -1, 0, 1, 8], np.int64)
    found = blocks.dealt(g, [doc], "drd", 1, sizes, values)
    assert found.column("g").to_pylist() == [3, 5, 9] and found.column("kind").to_pylist() == [1, 1, 1]
    got = blocks.joined(found.column("data").to_pylist(), "drd")
    assert [c.tolist() for c in got] == [doc.tolist(), sizes.tolist(), values.tolist()]
    assert [c.tolist() for c in blocks.joined([blocks.encode([doc[:0], sizes], "dr")], "dr")] == [[], sizes.tolist()]
    assert blocks.ranges(np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]
    many = blocks.group_of(np.arange(-5000, 5000), 16)
    assert set(many.tolist()) == set(range(16)) and np.bincount(many).max() < 1000


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("at_once", [blocks.GATHERED, 40])
def test_unique_examples_of_links_are_those_of_rows(spark, monkeypatch, wide, at_once):
    """Against the operator on a row for each mention and candidate: nulls, repeated links, anchors without entities, wide ids."""
    monkeypatch.setattr(blocks, "GATHERED", at_once)
    rng = random.Random(5)
    far = (lambda e: (e - 6) * (1 << 59)) if wide else (lambda e: e)
    none = lambda x, p: None if rng.random() < p else x
    rows = [(none(rng.randrange(40), 0.05), none(rng.randrange(25), 0.05), none(far(rng.randrange(13)), 0.05), none(rng.choice([0.0, -1.0, 2.0, 2.0, 3.0, 2.5]), 0.05)) for _ in range(400)]
    rows += [(41, 90, None, 2.0), (41, 91, far(3), None), (42, 91, far(3), None), (None, 92, far(4), 1.0), (43, 93, far(3), 1.0), (43, 93, far(3), 1.0)]
    links = spark.createDataFrame(rows, "doc_id long, anchor_id long, entity long, weight double").repartition(3)
    mentions = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "mention_id long, doc_id long, anchor_id long")
    offers = links.groupBy("anchor_id", "entity").agg(F.sum("weight").cast("long").alias("cnt"), F.lit(0).alias("entity_cnt"))
    want = aggregates.unique_examples(mentions.join(offers, "anchor_id")).select("entity", "cnt", "total", "repeat")
    found = aggregates.unique_examples_of_links(links).select("entity", "cnt", "total", "repeat")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(found.collect()) == order(want.collect()) and want.where("repeat > 1").count() > 20
    assert aggregates.unique_examples_of_links(links.where("doc_id < 0")).count() == 0


def test_examples_are_not_joined_by_rows(spark, sf_small):
    plan = catalog.queries()["agg_unique_examples"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("reorder", [False, True])
@pytest.mark.parametrize("at_once", [blocks.GATHERED, 60])
def test_beams_of_links_are_those_of_rows(spark, monkeypatch, reorder, at_once):
    """Against beams over a row for each step and candidate: links without document, anchor or entity, anchors without entities."""
    monkeypatch.setattr(blocks, "GATHERED", at_once)
    monkeypatch.setattr(decode, "PART", at_once)
    monkeypatch.setattr(decode, "STEPS", at_once)
    rng = random.Random(7)
    none = lambda x, p: None if rng.random() < p else x
    rows = [(d, s, none(rng.randrange(30), 0.05), none(rng.randrange(-20, 60), 0.05)) for d in range(60) for s in range(1, d % 9 + 2)]
    rows += [(5, 20, 90, None), (5, 21, 91, 1 << 40)]
    links = spark.createDataFrame(rows, "doc_id long, step long, anchor_id long, entity long").repartition(3)
    offers = links.where("entity is not null").select("anchor_id", "entity").distinct()
    e, s = F.col("entity"), F.col("step")
    score = F.pmod(e * 31 + s * 7, F.lit(97)) / 10
    wide = links.select("doc_id", "step", "anchor_id").join(offers, "anchor_id").select("doc_id", "step", "entity", e.alias("pos"), score.alias("score"), (e % 6 != 0).alias("valid"))
    want = {(r.doc_id, r.step): (r.entity, r.score) for r in decode.beam(wide, 3, reorder, 0.5).collect()}
    rate = lambda e, step: ((e * 31 + step * 7) % 97 / 10, e % 6 != 0)
    assert {(r.doc_id, r.step): (r.entity, r.score) for r in decode.beam_of_links(links, rate, 3, reorder, 0.5).collect()} == want and len(want) > 250
    # links of no document are one document
    lost = links.withColumn("doc_id", F.nullif("doc_id", F.lit(17)))
    found = {(r.doc_id, r.step): (r.entity, r.score) for r in decode.beam_of_links(lost, rate, 3, reorder, 0.5).collect()}
    assert found == {(None if d == 17 else d, s): v for (d, s), v in want.items()}
    assert decode.beam_of_links(links.where("doc_id < 0"), rate, 3, reorder, 0.5).count() == 0


@pytest.mark.parametrize("name", ["dec_beam", "dec_reorder"])
def test_beams_deal_lines_once_as_rows(spark, sf_small, name):
    plan = catalog.queries()[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "Aggregate" not in plan
