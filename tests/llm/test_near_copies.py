"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline as P
from tessera.llm import near_copies as N


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def firsts(texts):
    """Smallest ids of the groups that chains of similarity 0.8 or more join."""
    group = {d: d for d in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    sets = {d: shingles(t) for d, t in texts.items()}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) > 0):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {root(d) for d in texts}


def copies():
    rng, texts = random.Random(3), {}
    for g in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 40, 150, 600]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.05):
            texts[len(texts)] = " ".join("new" + str(rng.random()) if rng.random() < share else w for w in words)
    return texts | {1000: "", 1001: None, 1002: "one two", 1003: "One Two", 1004: "one two three"}


@pytest.mark.parametrize("chunk", [2048, 2])
def test_groups_of_similarity_four_fifths(spark, chunk):
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = N.near_copies(docs, chunk).collect()
    assert len(found) == len(texts) and {r.component_id for r in found} == firsts(texts)


def test_the_stage_drops_copies_beyond_three_bits(spark):
    texts = copies()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(firsts(texts))


def test_pivots_make_candidates_beside_the_keys(spark):
    """Fingerprints within three bits, or equal, make candidates of nodes that share no key; all others need one."""
    base = 0x0123456789ABCDE
    rows = [(1, base, [1]), (2, base ^ 0b111, [2]), (3, base ^ 0b111, [3]), (4, ~base, [4]), (5, ~base ^ (0b1111 << 20), [5]), (6, 77, [6]), (7, ~77, [6])]
    prints = spark.createDataFrame(rows, "node long, fp long, bands array<bigint>")
    group = {n: n for n, _, _ in rows}
    for r in N.candidates(prints).collect():
        x, y = group[r.a], group[r.b]
        group = {n: min(x, y) if g in (x, y) else g for n, g in group.items()}
    assert group == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    texts = spark.createDataFrame(list(copies().items()), "doc_id long, text string")
    plan = N.near_copies(texts)
    assert plan.count() == len(copies())


def test_set_fingerprints_are_majorities(spark):
    from pyspark.sql import functions as F

    from tessera.llm.simhash import shingle_hashes

    docs = spark.createDataFrame([(1, "a b c d e f g a b c d e f"), (2, "one two"), (3, None)], "doc_id long, text string")
    hashed = docs.select("doc_id", F.lit(0).cast("long").alias("text_hash"), shingle_hashes(F.col("text"), 5).alias("h"))
    found = {r.doc_id: r.fp for r in hashed.mapInArrow(N._nodes, "doc_id long, text_hash long, node long, fp long, bands array<bigint>").collect()}
    for r in hashed.collect():
        own = {x & (1 << 64) - 1 for x in r.h}
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
        assert found[r.doc_id] & (1 << 64) - 1 == want
