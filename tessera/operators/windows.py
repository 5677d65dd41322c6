"""Ordered computations: gaps and islands, context windows, splits, lists, sampling order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("pos")


def gap_groups(tokens: DataFrame, window: int) -> DataFrame:
    """``tokens(doc_id, pos, blank, label)``: labelled places with ``group``; a gap over ``window`` or a blank line starts a new one."""
    para = F.sum(F.col("blank").cast("int")).over(_order("doc_id"))
    labels = tokens.withColumn("_para", para).where(F.col("label").isNotNull() & ~F.col("blank"))
    before, prior = F.lag("pos").over(_order("doc_id")), F.lag("_para").over(_order("doc_id"))
    new = before.isNull() | (F.col("pos") - before > window) | (F.col("_para") != prior)
    return labels.withColumn("_n", new.cast("int")).withColumn("group", F.sum("_n").over(_order("doc_id"))).select("doc_id", "pos", "label", "group", "_para")


def context_examples(tokens: DataFrame, window: int) -> DataFrame:
    """(doc_id, group, start, stop): each group's places from ``window`` before its first label to ``window`` after
    its last (stop exclusive), inside its paragraph."""
    para = F.sum(F.col("blank").cast("int")).over(_order("doc_id"))
    bounds = tokens.withColumn("_para", para).where(~F.col("blank")).groupBy("doc_id", "_para").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    groups = gap_groups(tokens, window).groupBy("doc_id", "group").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.first("_para").alias("_para"))
    return groups.join(bounds, ["doc_id", "_para"]).select("doc_id", "group", F.greatest(F.col("_first") - window, F.col("_lo")).alias("start"), F.least(F.col("_last") + window, F.col("_hi") + 1).alias("stop"))


def split_lines(lines: DataFrame, start: int, size: int, total: int | None = None) -> DataFrame:
    """``lines(n)`` with ``part``: validation is [start, start + size), train the rest below ``total``."""
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    if total is not None and total < start + size:
        raise ValueError("total must hold the validation part")
    out = lines.withColumn("part", F.when((F.col("n") >= start) & (F.col("n") < start + size), "validation").otherwise("train"))
    return out if total is None else out.where(F.col("n") < total)


def article_bounds(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, blank, context)`` with ``article``: a change of context cuts at the last blank line before it."""
    seen = F.last("context", True).over(_order("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    blank = F.last(F.when(F.col("blank"), F.col("pos")), True).over(_order("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    marks = tokens.withColumns({"_seen": seen, "_blank": blank})
    cuts = marks.where(F.col("context").isNotNull() & F.col("_seen").isNotNull() & (F.col("context") != F.col("_seen"))).select("doc_id", F.coalesce("_blank", F.col("pos")).alias("pos")).distinct().withColumn("_cut", F.lit(1))
    return tokens.join(cuts, ["doc_id", "pos"], "left").withColumn("article", F.sum(F.coalesce("_cut", F.lit(0))).over(_order("doc_id"))).drop("_cut")


def segments(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, anchor_id)`` to (doc_id, start, stop, anchor_id): runs of one anchor; null breaks."""
    new = ~F.col("anchor_id").eqNullSafe(F.lag("anchor_id").over(_order("doc_id")))
    rows = tokens.withColumn("_s", F.sum(new.cast("int")).over(_order("doc_id"))).where("anchor_id is not null")
    return rows.groupBy("doc_id", "_s").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.first("anchor_id").alias("anchor_id")).drop("_s")


def bio(tokens: DataFrame) -> DataFrame:
    """With ``bio``: B where an anchor begins, I inside it, O elsewhere (negative or null)."""
    before = F.lag("anchor_id").over(_order("doc_id"))
    has = F.coalesce(F.col("anchor_id") >= 0, F.lit(False))
    return tokens.withColumn("bio", F.when(~has, "O").when(F.col("anchor_id").eqNullSafe(before), "I").otherwise("B"))


def first_of_anchor(tokens: DataFrame) -> DataFrame:
    """With ``is_first``: the first token of an anchor's run."""
    return tokens.withColumn("is_first", F.col("anchor_id").isNotNull() & ~F.col("anchor_id").eqNullSafe(F.lag("anchor_id").over(_order("doc_id"))))


def propagate(tokens: DataFrame, flag: str) -> DataFrame:
    """A flag of any token of an anchor's run for all its tokens."""
    new = ~F.col("anchor_id").eqNullSafe(F.lag("anchor_id").over(_order("doc_id")))
    rows = tokens.withColumn("_s", F.sum(new.cast("int")).over(_order("doc_id")))
    return rows.withColumn(flag, F.when(F.col("anchor_id").isNull(), F.col(flag)).otherwise(F.max(flag).over(Window.partitionBy("doc_id", "_s")))).drop("_s")


def enumerations(mentions: DataFrame) -> DataFrame:
    """``mentions(doc_id, pos, joiner, types array)`` where ``joiner`` is what stands before a mention (``,``, ``and``,
    ``, and`` or null): with ``list_id`` (null outside), ``allowed`` (types all members share) and ``inside`` (all but the last).

    A list is a chain of commas that ends with an ``and``; one without a shared type is none.
    """
    linked = F.col("joiner").isin(",", "and", ", and")
    rows = mentions.withColumn("_c", F.sum((~F.coalesce(linked, F.lit(False)) | F.coalesce(F.lag("joiner").over(_order("doc_id")).isin("and", ", and"), F.lit(False))).cast("int")).over(_order("doc_id")))
    chain = Window.partitionBy("doc_id", "_c")
    size, ends = F.count(F.lit(1)).over(chain), F.max(F.coalesce(F.col("joiner").isin("and", ", and"), F.lit(False))).over(chain)
    shared = rows.select("doc_id", "_c", F.explode(F.array_distinct("types")).alias("_t")).groupBy("doc_id", "_c", "_t").agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy("doc_id", "_c").agg(F.count(F.lit(1)).alias("_size"))
    allowed = shared.join(sizes, ["doc_id", "_c"]).where("_n = _size").groupBy("doc_id", "_c").agg(F.array_sort(F.collect_list("_t")).alias("_allowed"))
    rows = rows.withColumns({"_n": size, "_e": ends}).join(allowed, ["doc_id", "_c"], "left")
    good = (F.col("_n") > 1) & F.col("_e") & F.col("_allowed").isNotNull()
    last = F.max("pos").over(chain) == F.col("pos")
    return rows.withColumns({"list_id": F.when(good, F.col("_c")), "allowed": F.when(good, F.col("_allowed")), "inside": good & ~last}).drop("_c", "_n", "_e", "_allowed")


def cumulative_share(weights: DataFrame) -> DataFrame:
    """``weights(group_id, pos, weight)`` with ``share``: running weight over the group's total."""
    own = Window.partitionBy("group_id")
    return weights.withColumn("share", F.sum("weight").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(own))


def length_batches(examples: DataFrame, batch_size: int, max_length: int) -> DataFrame:
    """``examples(group_id, pos, length)`` with ``batch``: a batch grows while its greatest length times its size stays
    below max_length * batch_size and it has fewer than batch_size.

    Where a batch ends depends on all before it in its group, so sorted rows are folded as they stream by: a group is
    never held, only the open batch's size and greatest length.
    """
    limit = max_length * batch_size

    def fold(batches):
        group, n, top, batch = object(), 0, 0, 0
        for part in batches:
            out = []
            for g, length in zip(part.column("group_id").to_pylist(), part.column("length").to_pylist(), strict=True):
                if g != group:
                    group, n, top, batch = g, 0, 0, 0
                if n and not (max(top, length) * (n + 1) < limit and n < batch_size):
                    n, top, batch = 0, 0, batch + 1
                n, top = n + 1, max(top, length)
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], names=[*part.schema.names, "batch"])

    rows = examples.select("group_id", "pos", F.col("length").cast("long").alias("length"))
    schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])
    return rows.repartition("group_id").sortWithinPartitions("group_id", "pos").mapInArrow(fold, schema)


def fair_chunks(sizes: DataFrame, n: int) -> DataFrame:
    """``sizes(pos, size)`` with ``chunk``: at most n contiguous chunks of near-equal sums, by running share of the total
    (block sums first, so no task orders the whole)."""
    b = sizes.withColumn("_b", F.floor(F.col("pos") / (1 << 16)))
    sums = b.groupBy("_b").agg(F.sum("size").alias("_s"))
    base = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    total = sums.agg(F.sum("_s").alias("_total"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_base")
    rows = b.join(base, "_b").withColumn("_before", before).join(F.broadcast(total))
    return rows.select("pos", "size", F.least(F.floor(F.col("_before") * n / F.greatest(F.col("_total"), F.lit(1))), F.lit(n - 1)).cast("int").alias("chunk"))


def shuffled(rows: DataFrame, key: str, seed: int, copies: int = 1) -> DataFrame:
    """Rows ``copies`` times in a hash-random, repeatable order (column ``order``)."""
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string"), F.lit(str(seed))))
    return each.withColumn("order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).orderBy("order", key, "copy")
