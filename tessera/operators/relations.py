"""Relations in long form: ``edges(src, dst, pos)``, a multiset; ``pos`` orders a source's targets.

A nested form is ``(src, dsts array)``.  All entity ids are bigint; unresolved is NULL, or
-1 where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def invert(edges: DataFrame) -> DataFrame:
    """Transpose; a target's sources are ordered by source, then by place."""
    order = Window.partitionBy("dst").orderBy("src", "pos")
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.row_number().over(order) - 1).alias("pos"))


def degree(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(idx, degree) for every entity, 0 where it has no edge."""
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return entities.join(counts, F.col("idx") == F.col("src"), "left").select("idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def is_empty(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return degree(edges, entities).select("idx", (F.col("degree") == 0).alias("is_empty"))


def nest(edges: DataFrame) -> DataFrame:
    """(src, dsts): targets in order of place."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("_l")).select("src", F.transform("_l", lambda x: x["dst"]).alias("dsts"))


def unnest(nested: DataFrame) -> DataFrame:
    """Lists per source to long form (the place in the list is ``pos``)."""
    return nested.select("src", F.posexplode("dsts").alias("pos", "dst")).select("src", "dst", "pos")


def gather(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, dsts) for each row of ``nodes(idx)``; an empty list where there is no edge."""
    lists = nest(edges.join(nodes.select(F.col("idx").alias("src")).distinct(), "src", "left_semi"))
    return nodes.join(lists, F.col("idx") == F.col("src"), "left").select("idx", F.coalesce("dsts", F.array().cast("array<bigint>")).alias("dsts"))


def padded_gather(nodes: DataFrame, edges: DataFrame, pad: int = -1) -> DataFrame:
    """As ``gather``, each list padded to the longest; a negative or null node is all padding."""
    lists = gather(nodes, edges)
    width = lists.agg(F.max(F.size("dsts")).alias("_w"))  # one row
    fill = F.array_repeat(F.lit(pad).cast("long"), (F.col("_w") - F.size("dsts")).cast("int"))
    return lists.join(F.broadcast(width)).select("idx", F.concat("dsts", fill).alias("dsts"))


def last_non_negative(values: Column) -> Column:
    """Last element that is 0 or more, else -1."""
    return F.coalesce(F.try_element_at(F.filter(values, lambda x: x >= 0), F.lit(-1)), F.lit(-1).cast("long"))


def insert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new(src, dst)`` after each source's last place (a new source starts at 0)."""
    ends = edges.groupBy("src").agg(F.max("pos").alias("_end"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    added = new.withColumn("_n", nth).join(ends, "src", "left").select("src", "dst", (F.coalesce("_end", F.lit(-1)) + F.col("_n")).cast("int").alias("pos"))
    return edges.select("src", "dst", F.col("pos").cast("int").alias("pos")).unionByName(added)


def insert_candidates(candidates: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new(anchor_id, entity)`` with the median count of its anchor (lower middle; 1 for a new anchor)."""
    middle = candidates.groupBy("anchor_id").agg(F.array_sort(F.collect_list("cnt")).alias("_c"), F.max("pos").alias("_end"))
    middle = middle.select("anchor_id", "_end", F.get("_c", F.floor((F.size("_c") - 1) / 2).cast("int")).alias("_m"))
    added = new.join(middle, "anchor_id", "left").select("anchor_id", "entity", F.coalesce("_m", F.lit(1)).cast("long").alias("cnt"), (F.coalesce("_end", F.lit(-1)) + 1).cast("int").alias("pos"))
    return candidates.select("anchor_id", "entity", "cnt", "pos").unionByName(added)


def values_mask(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with ``active``: whether the source is among ``active(idx)``."""
    marks = active.select(F.col("idx").alias("src")).distinct().withColumn("_a", F.lit(True))
    return edges.join(marks, "src", "left").select("src", "dst", "pos", F.coalesce("_a", F.lit(False)).alias("active"))


def remove_negatives(edges: DataFrame) -> DataFrame:
    """Drop edges with a negative target; places close up."""
    order = Window.partitionBy("src").orderBy("pos")
    return edges.where("dst >= 0").select("src", "dst", (F.row_number().over(order) - 1).alias("pos"))


def remap_rows(mapping: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of a weighted relation by ``mapping(new_id, old_id)``; unmapped rows go."""
    return mapping.join(candidates, F.col("old_id") == F.col("anchor_id")).select(F.col("new_id").alias("anchor_id"), "entity", "cnt", "pos")


def delta_encode(offsets: DataFrame) -> DataFrame:
    """``(idx, value)`` running values over dense ids to the places where they change and by how much."""
    before = offsets.select((F.col("idx") + 1).alias("idx"), F.col("value").alias("_before"))
    return offsets.join(before, "idx", "left").select("idx", (F.col("value") - F.coalesce("_before", F.lit(0))).alias("delta")).where("delta <> 0")


def delta_decode(deltas: DataFrame, entities: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Running sums of the changes over all of ``entities(idx)``: sums inside blocks of ids, plus those of the blocks before."""
    full = entities.join(deltas, "idx", "left").select("idx", F.coalesce("delta", F.lit(0)).alias("delta"), F.floor(F.col("idx") / block).alias("_block"))
    sums = full.groupBy("_block").agg(F.sum("delta").alias("_sum"))  # a row a block
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return full.join(before, "_block").select("idx", (F.col("_base") + F.sum("delta").over(inside)).alias("value"))


def resolve(links: DataFrame, entities: DataFrame, how: str = "drop") -> DataFrame:
    """``links(src, qid)`` to ids: unknown ones dropped, or kept as -1 (``how="keep"``)."""
    joined = links.join(entities, "qid", "inner" if how == "drop" else "left")
    return joined.select("src", "qid", F.coalesce("idx", F.lit(-1)).cast("long").alias("dst"))


# entity sets: DataFrames of distinct ``idx`` ------------------------------------------------
def ors(*sets: DataFrame) -> DataFrame:
    assert sets, "no sets"
    out = sets[0].select("idx")
    for s in sets[1:]:
        out = out.union(s.select("idx"))
    return out.distinct()


def ands(*sets: DataFrame) -> DataFrame:
    assert sets, "no sets"
    out = sets[0].select("idx").distinct()
    for s in sets[1:]:
        out = out.join(s, "idx", "left_semi")
    return out


def negate(truth: DataFrame, *falses: DataFrame) -> DataFrame:
    assert falses, "no sets"
    out = truth.select("idx").distinct()
    for s in falses:
        out = out.join(s, "idx", "left_anti")
    return out


def complement(entities: DataFrame, found: DataFrame) -> DataFrame:
    return entities.select("idx").distinct().join(found, "idx", "left_anti")


def concat(*parts: DataFrame) -> DataFrame:
    """Datasets one after another: rows keep (dataset, pos)."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn("dataset", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def unique_ordered(values: DataFrame) -> DataFrame:
    """``(pos, value)`` to the distinct values with the place of their first occurrence."""
    return values.groupBy("value").agg(F.min("pos").alias("pos"))


# sparse attributes: ``attributes(entity, value)``, absent is no row --------------------------
def compare(attributes: DataFrame, op: str, value) -> DataFrame:
    """Entities whose attribute is ``op`` value; an absent one never matches."""
    col = F.col("value")
    test = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value, "==": col == value}[op]
    return attributes.where(test).select(F.col("entity").alias("idx"))


def dense(attributes: DataFrame, entities: DataFrame) -> DataFrame:
    """(idx, value, present) with 0 for absent."""
    return entities.join(attributes, F.col("idx") == F.col("entity"), "left").select("idx", F.coalesce("value", F.lit(0)).alias("value"), F.col("entity").isNotNull().alias("present"))


def first_value(lists: DataFrame) -> DataFrame:
    """``(entity, values array)`` to the sparse attribute of first values."""
    return lists.where(F.size("values") > 0).select("entity", F.get("values", F.lit(0)).alias("value"))
