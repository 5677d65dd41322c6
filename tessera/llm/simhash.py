"""SimHash near-duplicates, found with pivot distance tables.

A document's fingerprint has bit i set where over half of its shingle hashes have it.
Equal fingerprints are one node.  A pivot table holds a fingerprint's Hamming distances to
reference fingerprints: the word 0, the 32 words with two neighbouring bits set (*pair
pivots*), and ``N_PIVOTS`` pseudo-random ones.  Coordinates make the candidates.  The
distances to 0 and to a pair pivot give how many of its two bits are set: (d0 + 2 - d) / 2,
the pair's *coordinate*; flipping one bit of a fingerprint changes one of its 32 pair
coordinates.  So fingerprints with at most ``MOST`` differing bits have equal coordinates in
all but ``MOST`` of ``n_groups`` groups of pairs, and each node is dealt into one bucket for
every choice of the groups that may agree; that loses no link.  Inside a bucket a pair whose
distances to any reference (0 and the random ones) differ by more than ``MOST`` is discarded
(triangle inequality); the survivors' differing bits are counted.

A bucket hands back spanning links only, never its pairs, and a bucket over ``CHUNK``
nodes is cut into chunks that are compared two by two in tasks of their own.

Defined results: null texts are empty; texts without words have fingerprint 0, and link
like any other; fewer words than a shingle make one shingle; repeated rows each get
their row; a null doc_id is never a component's id unless no document of it has one
(then component_id is null); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, words
from .components import components

SHINGLE, MOST, N_PIVOTS, CHUNK, SMALL = 3, 3, 16, 8192, 16
STEP = 1 << 16


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each space-joined shingle, repeats included; ``text`` may be null."""
    from .common import let

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle)])))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= shingle, each).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(text)), hashes)


def bit_votes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each list [offsets[i], offsets[i + 1]) of 64-bit words, how many have each bit set."""
    counts = np.zeros((len(offsets) - 1, 64), np.int64)
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    for s in range(0, len(values), STEP):
        part = values[s : s + STEP]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, s + len(part), "left")
        counts[full[lo:hi]] += np.add.reduceat(bits, np.maximum(starts[lo:hi] - s, 0), axis=0, dtype=np.int64)
    return counts


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("h")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
        offsets = offsets - offsets[0]
        votes = bit_votes(values, offsets)
        bits = (2 * votes > np.diff(offsets)[:, None]).astype(np.uint8)
        found = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64) if len(bits) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (tells texts apart under one doc_id), fp (bigint)."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), shingle_hashes(F.col("text"), shingle).alias("h"))
    return hashed.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random words by rule (SplitMix64 of 1, 2, ...)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def pair_pivots() -> np.ndarray:
    """Reference fingerprints with two neighbouring bits set."""
    return np.uint64(3) << (2 * np.arange(32, dtype=np.uint64))


def discarding() -> np.ndarray:
    """The references whose distances discard pairs inside a bucket."""
    return np.r_[np.uint64(0), pivots()]


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each reference and a column for each fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in references])


def _survivors(table: np.ndarray, left, right: np.ndarray, most: int) -> np.ndarray:
    """Places among ``right`` whose largest coordinate difference to ``left`` (one column, or one for each) is at most ``most``."""
    kept = np.arange(len(right))
    for row in table:
        a = row[left] if np.isscalar(left) else row[left[kept]]
        kept = kept[np.abs(row[right[kept]] - a) <= most]
    return kept


def spanning_links(fps: np.ndarray, most: int = MOST, references: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join exactly those of ``fps`` that chains of at most ``most`` differing bits join."""
    table = pivot_table(fps, discarding() if references is None else references)
    rest, links = np.arange(len(fps)), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = int(frontier.pop())
            near = _survivors(table, x, rest, most)
            near = near[np.bitwise_count(fps[rest[near]] ^ fps[x]) <= most]
            if len(near):
                hits = rest[near]
                links.append((np.full(len(hits), fps[x]), fps[hits]))
                frontier.extend(hits)
                rest = np.delete(rest, near)
    return links


def bucket_links(bucket: np.ndarray, fps: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``bucket``.  Short runs are compared place by place at once for
    all of them, long ones by ``spanning_links``."""
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[edges, len(bucket)])
    refs, found = discarding(), []
    for s, n in zip(edges[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        found += spanning_links(np.unique(fps[s : s + n]), most, refs)
    short = np.repeat(sizes <= SMALL, sizes) & np.repeat(sizes > 1, sizes)
    bucket, fps = bucket[short], fps[short]
    if len(fps):
        table = pivot_table(fps, refs)
        for lag in range(1, SMALL):
            left = np.flatnonzero(bucket[lag:] == bucket[:-lag]) if lag < len(bucket) else np.zeros(0, int)
            if not len(left):
                break
            kept = _survivors(table, left, left + lag, most)
            a, b = fps[left[kept]], fps[left[kept] + lag]
            near = np.bitwise_count(a ^ b) <= most
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket; the last bucket of a batch waits for the next one."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k, f):
        a, b = bucket_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column("bucket").to_numpy()]
        fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
        if len(keys) < STEP:
            continue
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] != keys[-1] else 0
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else cut
        if cut:
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    yield out(keys, fps)


def pair_coordinates(fp: Column) -> Column:
    """A fingerprint's 32 pair coordinates, two bits each, as one bigint: the distances to 0 and to
    each pair pivot, d0 and d, as (d0 + 2 - d) / 2.  Counting bits pairwise gives all of them at once."""
    low = F.lit(0x5555555555555555)
    both = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    one = fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def pivot_keys(fp: Column, n_groups: int, most: int = MOST) -> Column:
    """A bucket number (bigint) for each choice of n_groups - most groups of pair pivots: the choice's number and the coordinates there, hashed."""
    ends = [2 * (32 * i // n_groups) for i in range(n_groups + 1)]
    masks = [sum(1 << b for b in range(ends[i], ends[i + 1])) for i in range(n_groups)]
    keys = []
    for t, chosen in enumerate(combinations(range(n_groups), n_groups - most)):
        mask = sum(masks[i] for i in chosen)
        mask -= (1 << 64) * (mask >= 1 << 63)
        keys.append(F.xxhash64(F.lit(t), pair_coordinates(fp).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def near_links(fps: DataFrame, n_groups: int | None = None, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps(fp)`` that join what chains of links join."""
    if n_groups is None:  # more groups agree in more coordinates; either way no link is lost, and the cost of more pays from some 10^7 nodes on
        n_groups = 5 if fps.count() < 1 << 24 else 6
    rows = fps.select("fp", F.explode(pivot_keys(F.col("fp"), n_groups, most)).alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    hot = materialize(hot.select(F.col("bucket").alias("_b"), F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks")), "hot-buckets")
    rows = rows.join(hot, F.col("bucket") == F.col("_b"), "left")
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit("chunk")), F.col("_chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: F.xxhash64(F.col("bucket"), F.least(mine, j), F.greatest(mine, j)))
    rows = rows.select("fp", F.explode(F.when(F.col("_chunks").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_links, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints(doc_id, fp)``."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(near_links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id."""
    prints = materialize(fingerprints(docs, shingle), "simhash")
    named = materialize(classes(prints), "classes").withColumnRenamed("fp", "_fp")
    return prints.join(named, prints["fp"] == named["_fp"]).drop("_fp")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return firsts(docs, near_duplicates(docs, shingle))


def firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component in ``found``; of repeated rows one stays.

    Rows without doc_id stay only where their component has no doc_id at all.
    """
    # a component is named by its root fingerprint's smallest doc_id; those without ids are told apart by their fingerprint
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.lit(1).alias("_one"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_h"))
    joined = rows.join(stays, rows["_i"].eqNullSafe(stays["_id"]) & (rows["_h"] == stays["_hash"]), "left_semi")
    one = joined.withColumn("_n", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.lit(1))))
    return one.where("_n = 1").select("_doc.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
