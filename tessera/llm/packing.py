"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin room.

A document is its token ids and an end id.  It is cut into full sequences and a rest; a
rest over half a sequence is cut once more at the half, so that no piece to be packed is
longer than half a bin, where first-fit decreasing leaves next to no room.  Cuts depend
on a document's own length alone, so one pass over the texts gives every piece with its
checksum; what is packed then is a table of lengths.

Pieces shorter than a sequence are dealt into random groups of about ``GROUP`` pieces
(by a hash of a row number fixed in the written table: no key makes a group large), and
each group is packed on its own: pieces by falling length go to the first bin with room,
found in a tournament tree that keeps the largest room of every range of bins.

Defined results: a null or empty text is the end id alone; repeated rows are packed as
documents of their own; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import re
import string
import sys
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SEQUENCE, END_ID, GROUP, SEED = 2048, 1, 8192, 7
#: Words a worker remembers the ids of; it forgets them all when there are more.
REMEMBERED = 500_000
#: Of those, the first so many stay when a worker forgets (and between tasks).
KEPT = 50_000
SIGNS = string.punctuation
#: Pieces of whole sequences are numbered from here, those of packed groups below.
ALONE = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of texts, by remembering those of words between spaces and line ends: word to number,
    number to its stretch of ``flat``.

    The tokenizer's own rules never join what such a blank separates, nor a letter and the signs
    after it; they lower-case letter by letter.  Some letters end in a mark once they are
    lower-cased or composed (such as U+0130), and a mark joins the signs after it: whether a last
    letter parts from signs is asked of the tokenizer, once a letter.  A text that may hold a
    special token's string goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile(r"[ \n\t\r]+").split
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[ends] = True
        self.tails: dict[str, np.ndarray] = {}
        self.parts: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all words but the first KEPT: the common ones come first."""
        kept = dict(islice(self.items(), KEPT)) or {"": 0}  # the empty word has no ids
        n = len(kept)
        starts, stops = (self.starts[:n].copy(), self.stops[:n].copy()) if n > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        flat = self.flat[: int(stops.max())].copy() if n > 1 else np.zeros(0, np.uint32)
        self.clear()
        self.update(kept)
        self.fresh: list[str] = []
        self.filled = len(flat)
        self.flat, self.starts, self.stops = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.flat[: len(flat)], self.starts[:n], self.stops[:n] = flat, starts, stops

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has: all at once, parted where a
        token ends a word.  That holds for words of letters; should the parts not be as many as
        the words, each word is looked at alone."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(cut, prepend=0)) if len(cut) == len(words) else self.alone(words)

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for c in codes for i in c], np.uint32), np.array([len(c) for c in codes], np.int64)

    def parts_from_signs(self, letter: str) -> bool:
        """Whether the tokenizer parts a word that ends in ``letter`` from ASCII signs after it."""
        if letter not in self.parts:
            alone, sign, both = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (letter, SIGNS, letter + SIGNS))
            self.parts[letter] = alone + sign == both
        return self.parts[letter]

    def learn(self) -> None:
        """Store the ids of the fresh words, which have the last numbers."""
        fresh, self.fresh = self.fresh, []
        # a word of letters and the ASCII signs after it are looked up apart
        stems = [m if len(m := w.rstrip(SIGNS)) < len(w) and m.isalpha() and (m.isascii() or self.parts_from_signs(m[-1])) else w for w in fresh]
        order = {w: None for w in stems}
        letters, others = [w for w in order if w.isalpha()], [w for w in order if not w.isalpha()]
        place = {w: i for i, w in enumerate(letters + others)}
        parts = [self.codes(letters[s : s + 1000]) for s in range(0, len(letters), 1000)]
        if others:
            parts.append(self.alone(others))
        known, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at = np.fromiter(map(place.__getitem__, stems), np.int64, len(stems))
        tails = [w[len(m) :] for w, m in zip(fresh, stems, strict=True)]
        for tail in set(tails) - self.tails.keys():
            self.tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids if tail else [], np.uint32)
        ended = [self.tails[x] for x in tails]
        pointed = np.fromiter(map(len, ended), np.int64, len(ended))
        stop_at = np.cumsum(counts)[at]
        lengths = counts[at] + pointed
        n, total = len(self), int(lengths.sum())
        while n > len(self.starts):
            self.starts, self.stops = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.stops, 2 * len(self.stops))
        while self.filled + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        ends = np.cumsum(lengths)
        source = np.repeat(stop_at + pointed - ends, lengths) + np.arange(total)
        own = np.arange(total) < np.repeat(ends - pointed, lengths)
        new = np.empty(total, np.uint32)
        new[own] = known[source[own]]
        new[~own] = np.concatenate([x for x in ended if len(x)]) if not own.all() else []
        self.flat[self.filled : self.filled + total] = new
        self.stops[n - len(fresh) : n], self.starts[n - len(fresh) : n] = self.filled + ends, self.filled + ends - lengths
        self.filled += total

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > REMEMBERED:
            self.forget()
        numbers = []
        for text in texts:
            low = text.lower() if text.isascii() else text
            if "<|" in low and any(s in low.lower() for s in self.special):
                numbers.append(None)
                continue
            words = self.split(low) if "\t" in low or "\r" in low else low.replace("\n", " ").split(" ")
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.fresh:
            self.learn()
        out = []
        for text, n in zip(texts, numbers, strict=True):
            if n is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            starts = self.starts[n]
            lengths = self.stops[n] - starts
            ends = np.cumsum(lengths)
            shift = np.repeat(starts - (ends - lengths), lengths)
            shift += np.arange(len(shift))
            out.append(self.flat[shift])
        return out


def cuts(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    rest, half = n % sequence, sequence // 2
    return [sequence] * (n // sequence) + ([half, rest - half] if rest > half else [rest] if rest else [])


def _pieces(path: str, sequence: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sys.__dict__.setdefault("_tessera_word_ids", {})  # the tokenizer outlives the task, as workers are used again
        words = known.get(path) or known.setdefault(path, WordIds(path))
        try:
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                for s in range(0, len(doc_ids), 256):
                    rows = []
                    part = [t or "" for t in texts[s : s + 256].to_pylist()]
                    for doc_id, ids in zip(doc_ids[s : s + 256], words.ids(part), strict=True):
                        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                        start = 0
                        for length in cuts(len(ids), sequence):
                            rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids)))
                            start += length
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            words.forget()  # an idle worker holds few words

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), a row for each piece of each row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_pieces(tokenizer or default_tokenizer(), sequence, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.  ``room`` is a tournament tree: leaf i is the room of bin i, a
    node the larger of its two; the first bin with room is found walking down from the root."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def _pack_group(sequence: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True])
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), sequence)
        return frame.assign(sequence_id=(int(key[0]) << 24) + bins, offset=offsets).drop(columns=["uid", "grp"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """The pieces with sequence_id and offset (the place inside the sequence, gapless from 0)."""
    cut = materialize(pieces(docs, tokenizer, sequence, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    alone = cut.where(F.col("length") == sequence).withColumn("sequence_id", F.col("uid") + F.lit(ALONE)).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    rest = cut.where(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.groupBy("grp").applyInPandas(_pack_group(sequence), out)
    return alone.unionByName(packed)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
