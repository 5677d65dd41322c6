"""Order MinHash: properties of the fingerprints, and the edited texts against plain Python."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import order_minhash as omh


def edited(rows):
    """{row number: (edited text, next row number)} of (doc_id, text) rows in falling order."""
    out = []
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        cut = len(text) // 3
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest()))
    return out


def test_whole_table_and_blocks(spark, sf_small, monkeypatch):
    monkeypatch.setattr(omh.with_next, "__defaults__", (16,))
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()]
    got = omh.op8_order_minhash(spark, sf_small).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited(rows))
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_order_matters(spark):
    a, b = " ".join(f"a{i}" for i in range(600)), " ".join(f"b{i}" for i in range(600))
    rows = [(a + " " + b,), (b + " " + a,), (a + " " + b + " end",)]
    s = spark.createDataFrame(rows, "text string").select(F.collect_list(omh.sketches(F.col("text"))).alias("s"))
    like = lambda i, j: omh.likeness(F.get("s", F.lit(i)), F.get("s", F.lit(j)))
    swapped, grown, same = s.select(like(0, 1), like(0, 2), like(1, 1)).first()
    assert same == 1 and grown > 0.8 and swapped < 0.75


def test_order_matters_in_short_texts(spark):
    """Halves swapped: the k-mers but two stay, so sets of them would be alike by 0.67 to 0.95; their order is not."""
    rows = []
    for n in (12, 20, 40, 80):
        for i in range(40):
            w = [f"w{i}x{n}x{j}" for j in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    like = omh.likeness(omh.sketches(F.col("a")), omh.sketches(F.col("b")))
    for r in spark.createDataFrame(rows, "n int, a string, b string").select("n", like.alias("l")).groupBy("n").agg(F.avg("l").alias("l")).collect():
        kmers = r.n - 2
        assert r.l < 0.7 * (kmers - 2) / (kmers + 2), r


def brute_sketches(text):
    """By the definition: number each k-mer by occurrence, hash, choose a sketch, keep what follows its lower end, restore text order, hash."""
    import re

    import xxhash

    def h(*parts):
        seed = 42
        for kind, p in parts:
            raw = p.encode() if kind == "s" else p.to_bytes({"i": 4, "l": 8}[kind], "little")
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
        return seed

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kmers = [w[i : i + omh.K] for i in range(len(w) - omh.K + 1)] or ([[" ".join(w)]] if w else [])
    seen, per = {}, {}
    for place, kmer in enumerate(kmers):
        code = h(*[("s", x) for x in kmer]) >> 32
        seen[code] = seen.get(code, -1) + 1
        element = h(("l", code), ("i", seen[code])) >> 32
        per.setdefault(element * omh.M >> 32, []).append((element, place))
    out, everything = [], sorted(e for own in per.values() for e in own)
    for number in sorted(per):
        first = everything.index(min(per[number]))
        least = sorted(((everything * 2)[first : first + omh.L]), key=lambda e: e[1])
        out.append(number << 32 | h(*[("l", e) for e, _ in least]) >> 32)
    return out


def test_against_plain_python(spark, sf_small):
    made = [" ".join(f"w{i % 7}" for i in range(200)) + " tail of words here", "a a a a a a", "one two", "", None, "x"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in made], "text string"))
    for text, got in docs.select("text", omh.sketches(F.col("text"))).collect():
        assert got == brute_sketches(text)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "a b"), (6, long), (7, long), (7, long), (None, "x 🎉 y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("next", F.lit("clash"))
    got = omh.edited_pairs(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), omh.as_string(F.col("fp")).alias("f"), omh.likeness(F.col("fp"), F.col("edited_fp")).alias("l")).collect()
    order = sorted(rows, key=lambda r: -(r[0] or -1))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(edited(order), key=key)
    assert all(r.f == "" and r.l == 1.0 for r in got if r.n_chars == 0)
    assert len({r.f for r in got if r.n_chars == len(long)}) == 1
    assert omh.edited_pairs(docs.where("false")).count() == 0
    one = omh.edited_pairs(docs.where("doc_id = 4")).first()
    assert one.edited == "ono"


def test_a_hot_id_fills_several_blocks(spark):
    rng = random.Random(4)
    rows = [(5 if i % 3 == 0 else -(2**63) if i % 3 == 1 else rng.randrange(50), rng.randrange(-(2**63), 2**63)) for i in range(3000)]
    df = spark.createDataFrame(rows, "_id long, _tie long")
    found = omh.with_next(df, lambda r: r, block=100).select("_id", "_tie", "_block", "next._id", "next._tie").collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert {tuple(r)[:2]: tuple(r)[3:] for r in found} == {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    sizes = Counter(r._block for r in found)
    assert len(sizes) > 20 and max(sizes.values()) < 400
