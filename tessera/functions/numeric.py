"""Numbers and arrays on columns: probabilities, losses, buckets, gathers, hashes of settings."""

from __future__ import annotations

import hashlib
import importlib
import json
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_probs(cnt: Column, total: Column, entity_total: Column, power: float = 1.0) -> Column:
    """Struct (by_anchor, by_entity): shares with denominators of at least 1, raised, kept in [0, 1]."""
    one = lambda d: F.least(F.greatest(F.pow(cnt / F.greatest(d, F.lit(1)), F.lit(power)), F.lit(0.0)), F.lit(1.0))
    return F.struct(one(total).alias("by_anchor"), one(entity_total).alias("by_entity"))


def tag_probs(rows: DataFrame, buckets: tuple[str, ...] = ("adj", "noun", "other", "multiword")) -> DataFrame:
    """Per bucket P(entity | anchor, bucket), P(anchor, bucket | entity), P(bucket | anchor), and log1p(in ** 0.2).

    ``rows(anchor_id, entity, <buckets>, entity_cnt)``.
    """
    own = Window.partitionBy("anchor_id")
    everything = sum((F.col(b) for b in buckets), F.lit(0))
    total = F.sum(everything).over(own)
    safe = lambda x: F.greatest(x, F.lit(1))
    cols = {f"e_{b}": F.col(b) / safe(F.sum(b).over(own)) for b in buckets}
    cols |= {f"a_{b}": F.col(b) / safe(F.col("entity_cnt")) for b in buckets}
    cols |= {f"t_{b}": F.sum(b).over(own) / safe(total) for b in buckets}
    return rows.withColumns(cols | {"log_in": F.log1p(F.pow(F.col("entity_cnt"), F.lit(0.2)))})


def date_bucket(date: Column, start: int, divisor: int, n: int) -> Column:
    return F.least(F.greatest(F.floor((date - start) / divisor), F.lit(0)), F.lit(n - 1)).cast("int")


def frequency_weight(is_most_frequent: Column, usual: float, rare: float) -> Column:
    """Weight of an example by whether its label is its most frequent candidate."""
    return F.when(is_most_frequent, F.lit(usual)).otherwise(F.lit(rare))


def pool(vectors: DataFrame, how: str) -> DataFrame:
    """``vectors(segment, pos, vec array<double>)`` to (segment, vec), element by element: max, mean, first or lme
    (the logarithm of the mean of exponentials, taken of what lies below the maximum, so that none overflows)."""
    each = vectors.select("segment", "pos", F.posexplode("vec").alias("i", "x"))
    x = F.col("x").cast("double")
    if how == "lme":
        each = each.withColumn("_top", F.max(x).over(Window.partitionBy("segment", "i")))
    agg = {"max": F.max(x), "mean": F.avg(x), "first": F.min_by(x, "pos"), "lme": F.max("_top") + F.log(F.avg(F.exp(x - F.col("_top"))))}[how]
    return each.groupBy("segment", "i").agg(agg.alias("x")).groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax_nll(scores: DataFrame, masked: float = -50.0) -> DataFrame:
    """``scores(mention_id, pos, score, valid)`` to (mention_id, nll) of candidate 0; invalid ones score ``masked``."""
    s = F.when(F.col("valid"), F.col("score")).otherwise(F.lit(masked))
    rows = scores.withColumn("_s", s)
    top = F.max("_s").over(Window.partitionBy("mention_id"))
    rows = rows.withColumn("_top", top)
    return rows.groupBy("mention_id").agg((F.first("_top") + F.log(F.sum(F.exp(F.col("_s") - F.col("_top")))) - F.max(F.when(F.col("pos") == 0, F.col("_s")))).alias("nll"))


def ranking_loss(scores: DataFrame, margin: float = 1.0) -> DataFrame:
    """(mention_id, loss): sum of max(0, score + margin - score of candidate 0) over the others."""
    first = F.max(F.when(F.col("pos") == 0, F.col("score"))).over(Window.partitionBy("mention_id"))
    rows = scores.withColumn("_first", first).where("pos > 0")
    return rows.groupBy("mention_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("score") + margin - F.col("_first"))).alias("loss"))


def masked_loss(rows: DataFrame) -> DataFrame:
    """``rows(objective, nll, weight, mask)`` to (objective, loss): weighted mean over masked rows."""
    w = F.when(F.col("mask"), F.col("weight")).otherwise(F.lit(0.0))
    return rows.groupBy("objective").agg((F.sum(F.col("nll") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"))


def label_mask(label: Column) -> Column:
    """Struct (index, mask): a null label is index 0, masked out."""
    return F.struct(F.coalesce(label, F.lit(0)).alias("index"), label.isNotNull().alias("mask"))


def pad(values: Column, width: int, fill) -> Column:
    return F.concat(F.slice(values, 1, width), F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(values), F.lit(0))))


def segment_ids(lengths: DataFrame) -> DataFrame:
    """``lengths(row, length)`` to each row id ``length`` times."""
    return lengths.where("length > 0").select("row", F.posexplode(F.array_repeat("row", F.col("length").cast("int"))).alias("pos", "segment")).select("segment", "pos")


def gather(values: Column, index: Column) -> Column:
    """Values at each place of ``index``; null for a negative or outer one."""
    return F.transform(index, lambda i: F.when(i >= 0, F.get(values, i)))


def scatter(values: Column, index: Column, width: Column) -> Column:
    """An array of ``width`` with values put at their index, the last one of an index counting, null elsewhere."""
    place = lambda j: F.try_element_at(F.filter(F.arrays_zip(index.alias("i"), values.alias("v")), lambda p: p["i"] == j), F.lit(-1))["v"]
    return F.transform(F.sequence(F.lit(0), width - 1), place)


def place_first(candidates: DataFrame) -> DataFrame:
    """``candidates(mention_id, pos, is_label, ...)`` with places renumbered: the label first, the others in order."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("is_label"), "pos")
    return candidates.withColumn("pos", F.row_number().over(order) - 1)


def select_places(candidates: DataFrame, keep: Column) -> DataFrame:
    """Candidates that ``keep`` holds for, places closed up."""
    kept = candidates.where(keep)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("mention_id").orderBy("pos")) - 1)


def nested_hash(settings) -> str:
    """SHA-1 of nested settings, in whatever order a mapping's keys come."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def make_callable(spec):
    """``"module:function"``, or ``{"function": ..., "args": {...}}`` with arguments filled in."""
    if callable(spec):
        return spec
    name, args = (spec["function"], spec.get("args", {})) if isinstance(spec, dict) else (spec, {})
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return partial(found, **args) if args else found
