"""Mixing sources to target weights (DataFrame functions only).

Each document gets a hash-random key.  Within a source, documents in key order are
dealt into buckets by key range (about the square root of the source's document count
of them), so that a source of any size is sorted and summed in parallel: bucket totals
are summed per source, then running sums inside each bucket give every document its
place [start, start + size) in the source's random order.  A source with target T and
size S takes all documents ``T // S`` times, and once more those that lie before
``T % S``; the document across that point gives just the words before it.

Defined results: a null or blank text has size 0 and takes 0; null sources form one
source, ordered last; repeated rows are documents of their own; empty tables give
empty results; reruns agree, as keys depend on the doc_id, the text and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize, table, words

WEIGHTS, SHARE_PERCENT, MOST_EPOCHS, SEED = (3, 1, 2), 150, 2, "mix-1"
#: Keys are this many hexadecimal digits of an MD5 sum.
DIGITS = 13


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """By the text as well, so that many rows under one doc_id, or under none, get many keys."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) to the same with ``target``: the mix shared by weight, each
    source held to ``most_epochs`` times its size and the excess shared on by weight.

    Sources whose cap lies lowest for their weight fill first: in order of cap / weight,
    a source is full if the others, at that level, could still take the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    listed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), nth)).withColumn("cap", most_epochs * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(share_percent) / 100
    rest = listed.select(
        "source", "source_size", "n_docs", "weight", "cap",
        (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    level = F.col("left") / F.col("open_weight")
    # the first source that its level does not fill sets the level of all after it
    rest = rest.withColumn("level", F.when(F.col("cap") > level * F.col("weight"), level))
    lowest = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rest.select("source", "source_size", "n_docs", F.when(lowest.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), lowest * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, more: tuple[Column, ...] = (), **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, key, and ``more``."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"), *more,
    )
    return take(materialize(slim, "mix-sizes"), **settings)


def take(slim: DataFrame, **settings) -> DataFrame:
    per_source = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    shares = materialize(targets(per_source, **settings), "mix-targets")
    named = shares.withColumnRenamed("source", "_s")
    joined = slim.join(named, slim["source"].eqNullSafe(named["_s"]), "left").drop("_s")
    many = F.ceil(F.sqrt(F.col("n_docs").cast("double")))
    dealt = joined.withColumn("bucket", F.floor(F.col("key") * (many / F.lit(float(16**DIGITS)))).cast("long"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["bucket"] == offsets["_b"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    start = F.col("offset") + F.col("_within")
    last = F.least(F.greatest(budget - epochs * F.col("source_size") - start, F.lit(0)), F.col("size"))
    more = [c for c in slim.columns if c not in ("doc_id", "source", "size", "key")]
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), "key", *more)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one across a source's budget
    cut after its last word taken.  The columns of ``docs``; n_chars follows a cut text.

    A document meets its share by (doc_id, text hash), so its words are split but once; copies
    that the input holds twice under one doc_id are told apart by a row number among them.
    """
    from .common import let

    names = docs.columns
    shares = mix(docs, more=(F.xxhash64("text").alias("text_hash"),), **settings)
    twin = lambda *by: Window.partitionBy(*by)
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("source").cast("string").alias("_from"))
    left = left.withColumn("_n", F.row_number().over(twin("_id", "_hash", "_from").orderBy(F.lit(1))))
    right = shares.where("taken > 0").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("size").alias("_size"), "taken", F.col("source").alias("_s"))
    right = right.withColumn("_m", F.row_number().over(twin("_i", "_h", "_s").orderBy(F.desc("taken"))))
    both = left.join(right, left["_id"].eqNullSafe(right["_i"]) & (left["_hash"] == right["_h"]) & left["_from"].eqNullSafe(right["_s"]) & (left["_n"] == right["_m"]))
    whole = (F.col("taken") / F.col("_size")).cast("long")
    part = F.col("taken") - whole * F.col("_size")
    copies = F.filter(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.array(part)), lambda p: p >= 0)
    copies = F.when(part > 0, copies).otherwise(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")))
    each = both.select("_doc", F.explode(copies).alias("_cut"))
    head = let(F.regexp_extract_all(F.col("_doc.text"), F.lit(f"[{BLANK}]*[^{BLANK}]+"), 0), lambda t: F.array_join(F.slice(t, 1, F.col("_cut").cast("int")), ""))
    cut = F.when(F.col("_cut") == 0, F.col("_doc.text")).otherwise(head)
    out = each.withColumn("_text", cut)
    value = lambda c: {"text": F.col("_text"), "n_chars": F.when(F.col("_cut") == 0, F.col("_doc.n_chars")).otherwise(F.char_length("_text").cast("long"))}.get(c, F.col(f"_doc.`{c}`"))
    return out.select(*[value(c).alias(c) for c in names])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")
