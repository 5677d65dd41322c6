"""Order MinHash fingerprints (DataFrame functions only).

A text's symbols are its words, its k-mers runs of ``K`` words, each numbered by its
occurrence (the second time a k-mer appears it is another element).  Every numbered
k-mer has one hash; its top bits choose one of ``M`` sketches, and each sketch that has an
element keeps the ``L`` elements that follow its lower end in hash order (its own smallest
ones; where it has too few, the next sketches', round the end), puts them back in text
order, and hashes that tuple.  So a tuple tells the order of ``L`` elements in texts of any
length but of a single k-mer.  Moving a passage changes the tuples though the set of k-mers
stays: the likeness of two fingerprints (equal sketches over sketches that either text
fills) falls with edits, not just with lost k-mers.  One hash for each element (not M)
keeps the cost linear.

Elements are packed as 32 hash bits above 31 bits of place in one long, so that sorting
is that of plain numbers.  (In a text of n k-mers two different ones have the same 32 bits
with a chance of about n * n / 2^33; they then count as occurrences of one.)

Defined results: null texts are empty; a text without words has the empty fingerprint;
fewer than ``K`` words make one k-mer; two empty fingerprints have likeness 1, an empty
and another 0; repeated rows are documents of their own, ordered by text hash; rows
without doc_id come last; a single document is its own next; empty tables give empty
results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, table, words

K, L, M = 3, 2, 64
PLACE_BITS, HASH_BITS = 31, 32
#: Documents of a block in which the next document is looked up.
BLOCK = 1000
MOST_BLOCKS = 1 << 16


def _pack(h: Column, place: Column) -> Column:
    """The hash's top 32 bits, then the place."""
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _starts(values: Column, key) -> Column:
    """Places (from 0) in a sorted array where a run of equal ``key`` starts."""
    numbered = F.transform(values, lambda x, i: F.when(i.eqNullSafe(F.lit(0)) | (key(x) != key(F.get(values, i - 1))), i).otherwise(F.lit(-1)))
    return F.filter(numbered, lambda i: i >= 0)


def _runs(values: Column, starts: Column, of) -> Column:
    """``of(start, end)`` for each run."""
    return F.transform(starts, lambda s, r: of(s, F.coalesce(F.get(starts, r + 1), F.size(values))))


def _numbered(kmers: Column) -> Column:
    """Sorted packed (hash, place) of k-mers to sorted packed (hash of k-mer and occurrence, place)."""

    def number(s: Column, e: Column) -> Column:
        return F.transform(F.slice(kmers, s + 1, e - s), lambda x, o: _pack(F.xxhash64(_hash(x), o), _place(x)))

    return let(_starts(kmers, _hash), lambda starts: F.sort_array(F.flatten(_runs(kmers, starts, number))))


def sketches(text: Column, k: int = K, l: int = L, m: int = M) -> Column:  # noqa: E741
    """For the sketches that ``text`` fills, in order: the sketch number above 32 bits of its tuple's hash."""
    bits = (m - 1).bit_length()
    assert m == 1 << bits, "m is a power of two"

    def kmers(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: _pack(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))
        one = F.array(_pack(F.xxhash64(F.array_join(w, " ")), F.lit(0)))
        return F.sort_array(F.when(F.size(w) >= k, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>")))

    sketch = lambda x: F.shiftright(x, PLACE_BITS + HASH_BITS - bits)

    def fold(elements: Column) -> Column:
        return let(F.concat(elements, F.slice(elements, 1, l - 1)), lambda round_the_end: tuples(elements, round_the_end))

    def tuples(elements: Column, round_the_end: Column) -> Column:
        def one(s: Column, _: Column) -> Column:
            least = F.slice(round_the_end, s + 1, l)
            in_order = F.array_sort(F.transform(least, lambda x: F.struct(_place(x).alias("p"), _hash(x).alias("h"))))
            tuple_hash = F.shiftrightunsigned(F.xxhash64(F.transform(in_order, lambda t: t["h"])), 32)
            return F.shiftleft(sketch(F.get(elements, s)), 32).bitwiseOR(tuple_hash)

        return let(_starts(elements, sketch), lambda starts: _runs(elements, starts, one))

    return let(let(let(words(text), kmers), _numbered), fold)


def as_string(sketched: Column) -> Column:
    """Ten hexadecimal digits for each filled sketch: two of its number, eight of its tuple."""
    return F.lower(F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Equal sketches over sketches filled in either; 1 for two empty fingerprints."""
    number = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _count_above(value: Column, ends: list[int], equal: bool) -> Column:
    """How many of ``ends`` lie above ``value`` (or are ``equal``).  A binary search in a constant
    array, so that tens of thousands of ends cost a handful of steps."""
    falling = F.split(F.lit(",".join(map(str, sorted(ends, reverse=True)))), ",").cast("array<bigint>")

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        end = F.get(falling, mid)
        above = F.coalesce(end >= value if equal else end > value, F.lit(False))
        low = F.when(a["lo"] >= a["hi"], a["lo"]).when(above, mid + 1).otherwise(a["lo"])
        high = F.when(a["lo"] >= a["hi"], a["hi"]).when(above, a["hi"]).otherwise(mid)
        return F.struct(low.alias("lo"), high.alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(ends).bit_length())), start, halve, lambda a: a["lo"])


def _block_of(value: Column, tie: Column, ends: list[int]) -> Column:
    """The block of a row, 0 for the largest values: how many of ``ends`` lie at or above it.  A value
    that is several of them (as quantiles, it holds as many blocks' rows) is cut by its ``tie``, a hash."""
    if not ends:
        return F.lit(0)
    share = tie.cast("double") / F.lit(2.0**64) + 0.5

    def cut(n: Column) -> Column:
        inside = F.least(F.floor(share * (n["to"] - n["after"])).cast("int"), n["to"] - n["after"] - 1)
        return F.when(n["to"] - n["after"] < 2, n["to"]).otherwise(n["after"] + 1 + inside)

    return let(F.struct(_count_above(value, ends, False).alias("after"), _count_above(value, ends, True).alias("to")), cut)


def with_next(rows: DataFrame, make, block: int = BLOCK) -> DataFrame:
    """``make(rows)`` with a struct ``next`` of all its columns for the row that follows in falling
    _id (ties by _tie; after the last comes the first).  ``make`` keeps _id, _tie, _block and _ghost.

    Rows are dealt once, into at most ``MOST_BLOCKS`` blocks of neighbouring ids, and meet
    their next inside their block.  Many rows of one id fill several blocks; only rows equal in
    _id and _tie (copies of one text under one id) are never parted.  The first row of each block also goes, as a ghost, to
    the end of the block before it; only those (id, tie) pairs are broadcast, one a block.
    """
    n_blocks = min(MOST_BLOCKS, max(1, rows.count() // block))
    wanted = [i / n_blocks for i in range(1, n_blocks)]
    ends = rows.agg(F.percentile_approx("_id", wanted, max(10_000, 10 * n_blocks))).first()[0] if wanted else []
    dealt = rows.withColumn("_block", _block_of(F.col("_id"), F.col("_tie"), ends or []))
    firsts = dealt.groupBy("_block").agg(F.max_by(F.struct("_id", "_tie"), F.struct(F.col("_id"), -F.col("_tie").cast("decimal(20,0)"))).alias("f"))
    around = Window.orderBy("_block")
    to = F.coalesce(F.lag("_block").over(around), F.max("_block").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = materialize(firsts.select(F.col("f._id").alias("_fid"), F.col("f._tie").alias("_ftie"), to.alias("_to")), "block-firsts")
    ghosts = dealt.join(F.broadcast(firsts), (F.col("_id") == F.col("_fid")) & (F.col("_tie") == F.col("_ftie"))).withColumn("_block", F.col("_to")).drop("_fid", "_ftie", "_to")
    both = make(dealt.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True))))
    inside = Window.partitionBy("_block").orderBy("_ghost", F.desc("_id"), "_tie")
    return both.withColumn("next", F.lead(F.struct(*both.columns)).over(inside)).where(~F.col("_ghost"))


def fingerprints(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_string(sketches(F.col("text"), **settings)).alias("fingerprint"))


def edited_pairs(docs: DataFrame, **settings) -> DataFrame:
    """Each text, its fingerprint, its edited text and its likenesses (see ``op8_order_minhash``)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_tie"),
    )
    paired = with_next(rows, lambda r: r.withColumn("fp", sketches(F.col("text"), **settings)))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next.text"), cut))
    found = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next.fp").alias("next_fp"))
    return found.withColumn("edited_fp", sketches(F.col("edited"), **settings))


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Every text against itself with its last third exchanged for the next document's start."""
    found = edited_pairs(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
