"""Packing: an exact round trip against the tokenizer, and little padding."""

import random
import unicodedata
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing


def expect(docs):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    return sorted((r.doc_id is None, r.doc_id or 0, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect())


def check(docs):
    rows = packing.pack(docs).collect()
    want = expect(docs)
    assert sum(r.length for r in rows) == sum(len(ids) for _, _, ids in want)
    pool = {}
    for none, doc, ids in want:
        pool.setdefault((none, doc, len(ids)), []).append(np.array(ids, "<u4"))
    for r in rows:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in pool[r.doc_id is None, r.doc_id or 0, r.doc_tokens])
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= packing.SEQUENCE
    starts = {}
    for r in rows:
        starts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    return rows, by


def test_round_trip_and_padding(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows, by = check(docs)
    used = sum(r.length for r in rows)
    assert len(by) <= -(-used // packing.SEQUENCE) + 2
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in covered.values():
        place = 0
        for start, length, _ in sorted(parts):
            assert start == place
            place += length
        assert place == parts[0][2]


def test_edge_cases(spark):
    long = " ".join(f"wörd{i % 5003}'s" for i in range(60_000))
    texts = [None, "", " ", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ é ́x a b a b a\x0bb a\x85b", "don't  can't\n'S '", long, long, "x" * 5000, "日本語のテキスト 🎉", "YENİ, ev TARİHİ. HALİ! क़, שׁ."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("clash")).withColumn("length", F.lit(1))
    check(docs)
    assert packing.pack(docs.where("false")).count() == 0


def test_ids_of_odd_words():
    """Words that end in every kind of character, before and after signs, against the tokenizer."""
    words, rng = packing.WordIds(packing.default_tokenizer()), random.Random(1)
    kinds = {}
    for c in map(chr, range(0x20, 0x30000)):
        kinds.setdefault(unicodedata.category(c), []).append(c)
    kinds = [cs for kind, cs in sorted(kinds.items()) if kind[0] != "C"]
    marked = [c for c in map(chr, range(0x20, 0x30000)) if c.isalpha() and not unicodedata.normalize("NFC", c.lower())[-1].isalpha()]
    assert "İ" in marked
    one = lambda: rng.choice([*"abXY", *",.!?'\"-s", *" \n\t", *rng.sample(marked, 6), *(rng.choice(cs) for cs in kinds)])
    texts = ["".join(one() for _ in range(rng.randrange(1, 25))) for _ in range(10_000)]
    for s in range(0, len(texts), 250):
        for text, ids in zip(texts[s : s + 250], words.ids(texts[s : s + 250])):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(lengths))]
