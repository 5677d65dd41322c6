"""Candidates that stay with their anchor: the same results as of rows a mention, without dealing a row for each mention and candidate."""

import pytest

from tessera.operators import candidates, decode
from tessera.plans import catalog

MENTIONS = [(10, 1, 0, 7, True), (11, 1, 1, 8, True), (12, 1, 3, 7, True), (20, 2, 0, 9, False), (21, 2, 1, 7, True)]
CANDIDATES = [(7, 1), (7, 2), (7, 5), (8, 3), (8, 4), (9, 1)]
EDGES = [(1, 3), (2, 3), (2, 4), (5, 9), (1, 7), (3, 4), (4, 2), (1, 1)]


def _frames(spark):
    mentions = spark.createDataFrame(MENTIONS, "mention_id long, doc_id long, step long, anchor_id long, comma_after boolean")
    return mentions, spark.createDataFrame(CANDIDATES, "anchor_id long, entity long")


def _of(anchor):
    return [e for a, e in CANDIDATES if a == anchor]


def _pairs():
    return [(a, b) for a in MENTIONS for b in MENTIONS if a[1] == b[1] and b[2] == a[2] + 1]


def test_places_by_anchor_against_loops(spark):
    mentions, cands = _frames(spark)
    found = candidates.place_comma_place(mentions, cands, spark.createDataFrame(EDGES, "entity long, region long"))
    got = {(r.first, r.second): sorted((x.entity, x.goal) for x in r.found) for r in found.collect()}
    want = {(a[0], b[0]): sorted((e, g) for e, g in EDGES if e in _of(a[3]) and g in _of(b[3])) for a, b in _pairs() if a[4]}
    assert got == {k: v for k, v in want.items() if v}
    # by mention as before
    wide = mentions.join(cands, "anchor_id").select("mention_id", "entity")
    again = candidates.place_comma_place(mentions, wide, spark.createDataFrame(EDGES, "entity long, region long"))
    assert {(r.first, r.second): sorted((x.entity, x.goal) for x in r.found) for r in again.collect()} == got


def test_places_are_not_counted_by_rows(spark, sf_small):
    _no_row_a_candidate(spark, sf_small, "join_place_comma_place")
    lines = catalog.queries()["join_place_comma_place"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate [first" in x for x in lines)


def test_past_predictions_are_not_joined_by_rows(spark, sf_small):
    lines = catalog.queries()["st_past_prediction"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate [doc_id" in x for x in lines)


def test_earlier_steps_in_order(spark):
    rows = spark.createDataFrame([(1, 2, 5), (1, 0, 5), (1, 1, 6), (2, 4, 7), (1, 5, 6)], "doc_id long, step long, label long")
    got = {(r.doc_id, r.step): sorted(r.earlier) for r in decode.earlier(rows, "label").collect()}
    assert got == {(1, 0): [], (1, 1): [5], (1, 2): [5, 6], (1, 5): [5, 6], (2, 4): []}


def test_extend_by_class_lists_no_pairs(spark, sf_small):
    rows = [(1, 1, 90, 0, True), (1, 2, 100, 1, False), (1, 3, 60, 2, True), (1, 4, 10, 3, False), (2, 1, 20, 0, True), (2, 2, 5, 1, False), (2, -1, 3, 2, False)]
    df = spark.createDataFrame(rows, "anchor_id long, entity long, cnt long, pos int, alternative boolean")
    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "entity long, class_id int")
    got = {(r.anchor_id, r.pos): r.entity for r in candidates.extend_by_class(df, classes, keep_min=25).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 4, (2, 0): 1, (2, 1): -1, (2, 2): -1}
    plan = catalog.queries()["flt_extend_relations"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # suppliers' classes, and their nations


def test_search_lists_no_candidates_of_mentions(spark, sf_small):
    """Counts of solved mentions against loops; an anchor's mentions and candidates are one row."""
    import random

    from tessera.operators import search

    rng = random.Random(4)
    bits = {e: [rng.random() < 0.4 for _ in range(4)] for e in range(12)}  # 12 to 14 have none
    offers = [(a, e, rng.choice([0, 0, 3, 5, 5, 8]), i) for a in range(20) for i, e in enumerate(sorted(rng.sample(range(14), rng.randrange(1, 7))))]
    mentions = [(i, rng.randrange(22), rng.randrange(15)) for i in range(400)]
    table = spark.createDataFrame(list(bits.items()), "entity long, bits array<boolean>")
    problem = search.Problem(spark.createDataFrame(mentions, "mention_id long, anchor_id long, label long"), spark.createDataFrame(offers, "anchor_id long, entity long, cnt long, pos int"), table, [0.5] * 4)

    def solved(axes):
        count = 0
        for _, anchor, label in mentions:
            left = [(cnt, -pos, e) for a, e, cnt, pos in offers if a == anchor and label in bits and e in bits and all(bits[e][x] == bits[label][x] for x in axes)]
            count += len(left) == 1 or max([x for x in left if x[0] > 0], default=(0, 0, None))[2] == label
        return count

    every = [frozenset(x for x in range(4) if m >> x & 1) for m in range(16)]
    assert problem.solved(every) == {p: solved(p) for p in every}
    assert problem.rows.count() <= 20 and problem.rows.columns == ["kinds"]


@pytest.mark.parametrize("reorder", [False, True])
@pytest.mark.parametrize("penalty", [0.0, 0.5, -0.5, 30.0])
def test_beams_in_place_are_those_of_rows(spark, reorder, penalty):
    from pyspark.sql import functions as F

    rows = [(d, s, sorted({(d * 7 + s * 5 + i * i) % 40 for i in range((d * 3 + s) % 11 + 1)})) for d in range(60) for s in range(d % 9 + 1)]
    steps = spark.createDataFrame(rows, "doc_id long, step long, entities array<bigint>")
    wide = steps.select("doc_id", "step", F.posexplode("entities").alias("pos", "entity"))
    e, s = F.col("entity"), F.col("step")
    scored = wide.select("*", ((e * 31 + s * 7) % 97 / 10).alias("score"), (e % 6 != 0).alias("valid"))
    want = {(r.doc_id, r.step): (r.entity, r.score) for r in decode.beam(scored, 3, reorder, penalty).collect()}
    found = decode.beam_in_place(steps, lambda e, step: ((e * 31 + step * 7) % 97 / 10, e % 6 != 0), 3, reorder, penalty)
    assert {(r.doc_id, r.step): (r.entity, r.score) for r in found.collect()} == want and len(want) == len(rows)


@pytest.mark.parametrize("name", ["dec_beam", "dec_reorder"])
def test_beams_deal_a_row_for_each_mention(spark, sf_small, name):
    from tessera.plans import corpus_q
    from tessera.plans.registry import Tables

    rows = Tables(spark, sf_small).sql(corpus_q.DS)
    found = catalog.queries()[name](spark, sf_small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [doc_id" in x for x in plan.split("\n"))
    want = decode.beam(rows, 4, name == "dec_reorder", 0.5)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_packed_numbers():
    import numpy as np

    values = np.array([0, -1, 1, 63, -64, 64, 127, 128, 1 << 40, -(1 << 62), (1 << 63) - 1, -(1 << 63), 5], np.int64)
    data, sizes = decode.pack(values)
    back, ends = decode.unpack(data)
    assert back.tolist() == values.tolist() and ends.tolist() == np.cumsum(sizes).tolist() and sizes[0] == 1
    assert len(decode.unpack(decode.pack(values[:0])[0])[0]) == 0


@pytest.mark.parametrize("name", ["srch_ga", "srch_cem"])
def test_searches_write_a_row_for_each_anchor(spark, sf_small, name, monkeypatch):
    from tessera.operators import search

    written = []
    keep = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, of: written.append(keep(df, of)) or written[-1])
    assert catalog.queries()[name](spark, sf_small).count() == 1
    anchors = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_partkey").distinct().count()
    assert [w.count() for w in written] == [anchors]
