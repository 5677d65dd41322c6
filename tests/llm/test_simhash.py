"""SimHash near-dedup against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(distinct, dtype=np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            parent[root(f)] = root(distinct[j])
    least = {}
    for d, f in zip(ids, fps):
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [least.get(root(f)) for f in fps]


def check(docs):
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f): c for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))}
    assert got == want


def test_whole_table(spark, sf_small):
    check(spark.read.parquet(f"{sf_small}/documents.parquet"))


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, long), (8, long), (8, long), (None, "one"), (9, "É a b"), (10, "é a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("h", F.lit(None).cast("int"))
    check(docs)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 4, 6, 7, 9, 10]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_links_join_the_same_components_in_long_and_short_buckets():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 4), dtype=np.uint64), axis=1) for c in centre]))
    want = brute_components(range(len(fps)), [int(f) for f in fps])

    def labels(links):
        parent = {int(f): int(f) for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert ((np.bitwise_count(a ^ b)) <= 3).all()
            for x, y in zip(a, b):
                parent[root(int(x))] = root(int(y))
        first = {}
        return [first.setdefault(root(int(f)), i) for i, f in enumerate(fps)]

    assert labels(simhash.spanning_links(fps)) == want
    assert labels([simhash.bucket_links(np.zeros(len(fps), np.int64), fps)]) == want


def test_hot_bucket_in_chunks(spark):
    rng = np.random.default_rng(7)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 5), dtype=np.uint64), axis=1))
    df = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    links = [(np.uint64(r.a & (2**64 - 1)), np.uint64(r.b & (2**64 - 1))) for r in simhash.near_links(df, chunk=16).collect()]
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(int(a))] = root(int(b))
    first = {}
    assert [first.setdefault(root(int(f)), i) for i, f in enumerate(fps)] == brute_components(range(len(fps)), [int(f) for f in fps])


def test_pair_coordinates_are_pivot_distances(spark):
    fps = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    table = simhash.pivot_table(fps, np.r_[np.uint64(0), simhash.pair_pivots()]).astype(int)
    df = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(fps)], "i int, fp long")
    for i, packed in df.select("i", simhash.pair_coordinates(F.col("fp"))).collect():
        assert [packed >> 2 * k & 3 for k in range(32)] == ((table[0, i] + 2 - table[1:, i]) // 2).tolist()


@pytest.mark.parametrize("groups", [5, 6])
def test_pivot_keys_lose_no_link(spark, groups):
    rng = np.random.default_rng(groups)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    df = spark.createDataFrame([(int(x.view(np.int64)), int(y.view(np.int64))) for x, y in zip(a, b)], "a long, b long")
    lost = df.where(~F.arrays_overlap(simhash.pivot_keys(F.col("a"), groups), simhash.pivot_keys(F.col("b"), groups))).count()
    assert lost == 0
