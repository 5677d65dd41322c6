"""Near copies by their shingle sets: the rule of the corpus pipeline.

Two texts are linked where the sets of their five-word shingles have a Jaccard similarity
of ``4/5`` or more; groups are what chains of links join.  Equal sets are one node.
Candidates are found as ``op10`` finds its links: SimHash fingerprints (of the sets'
shingle hashes), pivot tables whose coordinates make buckets and whose distances discard
pairs, and a count of the differing bits (``simhash.near_links``).  Three bits reach few of
the pairs of similarity 0.8, so there are others beside these: nodes that share one of ``BANDS`` keys of ``ROWS`` minimum hashes each: a pair of
similarity 0.8 has none in common with a chance of (1 - 0.8^5)^40 = 1.3e-7, a more
similar one with less.  Nodes that chains of shared keys join are a block; every pair of a
block that shares a shingle is counted exactly, whichever keys it has in common, and a
block over ``CHUNK`` nodes is compared chunk by chunk in tasks of its own.

Defined results: null texts are empty; texts without words are copies of each other;
fewer words than a shingle make one shingle; doc_ids as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import bit_votes, firsts, near_links, pivots, shingle_hashes

SHINGLE, BANDS, ROWS, CHUNK = 5, 40, 5, 2048
STEP = 1 << 15


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys for each list [offsets[i], offsets[i + 1]) of 64-bit words; no list may be empty."""
    factors, shifts = pivots(2 * BANDS * ROWS).reshape(2, -1)
    keys = np.empty((len(offsets) - 1, BANDS), np.uint64)
    i = 0
    while i < len(keys):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
        part, starts = values[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        for b in range(BANDS):
            key = np.full(j - i, b, np.uint64)
            for r in range(b * ROWS, (b + 1) * ROWS):
                key = (key ^ np.minimum.reduceat(part * (factors[r] | np.uint64(1)) + shifts[r], starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            keys[i:j, b] = key
        i = j
    return keys


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column, each sorted and without repeats, one after another; where each starts and the last ends."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    order = np.lexsort((values, owner))
    values = values[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])][: len(values)]
    return values[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(column)))].astype(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        values, offsets = _lists(batch, "h")
        node = [int.from_bytes(blake2b(values[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        bits = (2 * bit_votes(values, offsets) > np.diff(offsets)[:, None]).astype(np.uint8)
        fp = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64) if len(bits) else np.zeros(0, np.int64)
        full = np.diff(offsets) > 0
        keys = signatures(values, np.r_[0, offsets[1:][full]]).view(np.int64)
        places = np.r_[0, np.cumsum(full * BANDS)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(pa.array(places), pa.array(keys.reshape(-1)))], names=["doc_id", "text_hash", "node", "fp", "bands"])


def set_links(nodes: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly those nodes that chains of similar sets join."""
    n, size = len(nodes), np.diff(offsets)
    ids = np.unique(values, return_inverse=True)[1].reshape(-1)
    holders = np.repeat(np.arange(n), size)[np.argsort(ids, kind="stable")]
    count = np.bincount(ids)
    first = np.cumsum(count) - count
    rest, left, right = np.ones(n, bool), [], []
    for seed in range(n):
        if not rest[seed]:
            continue
        rest[seed], frontier = False, [seed]
        while frontier:
            x = frontier.pop()
            own = ids[offsets[x] : offsets[x + 1]]
            many = count[own]
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(holders[at], minlength=n)
            hits = np.flatnonzero(rest & (9 * shared >= 4 * (size[x] + size)))  # shared / union >= 4 / 5
            rest[hits] = False
            left.append(np.full(len(hits), nodes[x]))
            right.append(nodes[hits])
            frontier.extend(hits.tolist())
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block; the last block of a batch waits for the next one."""
    held: dict[int, np.ndarray] = {}
    block = None

    def out():
        nodes = np.array(list(held), np.int64)
        a, b = set_links(nodes, np.concatenate(list(held.values())), np.r_[0, np.cumsum([len(x) for x in held.values()])].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        values, offsets = _lists(batch, "h")
        for i, (key, node) in enumerate(zip(batch.column("block").to_pylist(), batch.column("node").to_pylist(), strict=True)):
            if key != block and held:
                yield out()
                held = {}
            block, held[node] = key, values[offsets[i] : offsets[i + 1]].copy()
    if held:
        yield out()


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b): links of ``prints(node, fp, bands)`` whose chains join each node with all that may be similar: by fingerprints
    that pivot tables find within ``simhash.MOST`` bits, and by shared keys."""
    # a fingerprint's least node stands for it, and all its nodes are candidates of each other
    owners = materialize(prints.groupBy("fp").agg(F.min("node").alias("hub")), "set-fingerprints")
    near = near_links(owners.select("fp"))
    end = lambda side: owners.select(F.col("fp").alias(side), F.col("hub").alias(f"_{side}"))
    by_bits = near.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    own = prints.select("node", F.col("fp").alias("_fp")).join(owners, F.col("_fp") == F.col("fp")).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    keys = prints.select("node", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").select(F.col("band").alias("_band"), "hub")
    by_keys = keys.join(hubs, F.col("band") == F.col("_band")).where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return by_keys.unionByName(own).unionByName(by_bits).distinct()


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (tells texts apart under one doc_id), component_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    hashed = slim.select("doc_id", "text_hash", shingle_hashes(F.col("text"), SHINGLE).alias("h"))
    prints = materialize(hashed.mapInArrow(_nodes, "doc_id long, text_hash long, node long, fp long, bands array<bigint>"), "shingle-sets")

    linked = components(materialize(candidates(prints), "candidates")).select("node", F.col("root").alias("block"))
    blocks = materialize(linked.unionByName(linked.select(F.col("block").alias("node"), "block").distinct()), "blocks")

    chunks = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks")).withColumnRenamed("block", "_block")
    mine = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("_chunks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: F.xxhash64("block", F.least(mine, j), F.greatest(mine, j)))
    # one text of each node that has a possible copy
    one = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))).alias("_one"))
    chosen = blocks.join(one, "node").select("block", "node", "_one.*").join(chunks, F.col("block") == F.col("_block")).select("node", "_id", "_hash", parts.alias("parts"))
    texts = slim.join(chosen, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = texts.select("node", F.explode("parts").alias("block"), shingle_hashes(F.col("text"), SHINGLE).alias("h"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = sets.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_verified, "a long, b long")
    roots = components(materialize(links, "near-copies")).withColumnRenamed("node", "_node")

    rooted = prints.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(roots, F.col("node") == F.col("_node"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select(F.col("node").alias("_n"), "component_id"), "copy-groups")
    return prints.join(named, F.col("node") == F.col("_n")).select("doc_id", "text_hash", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group of near copies; of repeated rows one stays."""
    return firsts(docs, near_copies(docs))
