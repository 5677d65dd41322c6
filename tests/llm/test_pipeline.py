"""The pipeline's stages against plain Python, each on what the one before kept."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import packing, quality_rules
from tests.llm.test_line_dedup import key
from tests.llm.test_mixing import water
from tests.llm.test_simhash import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs, spark.read.parquet(f"{tmp_path}/{name}")
        docs = seen[name][1]

    before, after = seen["quality rules"]
    metrics = quality_rules.score(before)
    levels = quality_rules.calibrate(metrics, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality_rules.judge(metrics, levels).where("kept").collect()}

    before, after = seen["line dedup"]
    texts, owner = {r.doc_id: r.text for r in before.collect()}, {}
    for d, text in sorted(texts.items()):
        for line in text.split("\n"):
            owner.setdefault(key(line), d)
    want = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d) for d, t in texts.items()}
    assert {r.doc_id: r.text for r in after.collect()} == want and all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen["near-dedup"]
    rows = before.orderBy("doc_id").collect()
    named = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(named))

    before, after = seen["mixing"]
    size = Counter()
    for r in before.collect():
        size[r.source] += len(r.text.split())
    order = sorted(size)
    target = dict(zip(order, water([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    words = Counter()
    for r in after.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == Counter({s: int(t + 1e-6) for s, t in target.items()})

    before, after = seen["packing"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pool = {}
    for r in before.collect():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        pool.setdefault((r.doc_id, len(ids)), []).append(ids)
    pieces = after.collect()
    assert sum(p.length for p in pieces) == sum(len(x) for xs in pool.values() for x in xs)
    for p in pieces:
        assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in pool[p.doc_id, p.doc_tokens])

    assert P.run(spark, FOLDER).agg(F.sum("length")).first()[0] == sum(p.length for p in pieces)


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a", "en", "s", 1), (2, "", "en", "s", 0), (3, "word " * 60, None, "s", 300), (3, "word " * 60, None, "s", 300), (4, " ".join(f"w{i}" for i in range(60)), "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_doc", F.lit("clash"))
    for name, stage in P.STAGES:
        for docs in (odd, odd.where("false")):
            out = stage(spark, docs, FOLDER)
            rows = out.collect()
            assert name == "packing" or out.columns == P.COLUMNS
            assert rows is not None
