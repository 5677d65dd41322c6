"""Queries of relations, entity sets and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relations as R

from . import inputs as I
from .registry import query

E, N, L = f"WITH e AS ({I.EDGES}), n AS ({I.ENTITIES})", f"n AS ({I.ENTITIES})", f"WITH e AS ({I.LINES})"


@query("join_invert", f"{L} SELECT dst AS src, src AS dst, CAST(row_number() OVER (PARTITION BY dst ORDER BY src, pos) - 1 AS INT) AS pos FROM e")
def _(t):
    return R.invert(t.sql(I.LINES)).select("src", "dst", F.col("pos").cast("int").alias("pos"))


@query("prj_edges", f"{E} SELECT idx, count(src) AS degree FROM n LEFT JOIN e ON idx = src GROUP BY idx")
def _(t):
    return R.degree(t.sql(I.EDGES), t.sql(I.ENTITIES))


@query("flt_is_empty", f"{E} SELECT idx, count(src) = 0 AS is_empty FROM n LEFT JOIN e ON idx = src GROUP BY idx")
def _(t):
    return R.is_empty(t.sql(I.EDGES), t.sql(I.ENTITIES))


@query("prj_csr_build", f"{L} SELECT src, CAST(to_json(list(dst ORDER BY pos)) AS VARCHAR) AS dsts FROM e GROUP BY src")
def _(t):
    return R.nest(t.sql(I.LINES)).select("src", F.to_json("dsts").alias("dsts"))


@query("prj_gather", f"{L} SELECT idx, CAST(to_json(coalesce(list(dst ORDER BY pos) FILTER (WHERE dst IS NOT NULL), [])) AS VARCHAR) AS dsts FROM (SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders WHERE o_orderkey % 3 = 0) LEFT JOIN e ON idx = src GROUP BY idx")
def _(t):
    nodes = t.sql("SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders WHERE o_orderkey % 3 = 0")
    return R.gather(nodes, t.sql(I.LINES)).select("idx", F.to_json("dsts").alias("dsts"))


@query("prj_padded_gather", f"{L}, g AS (SELECT idx, coalesce(list(dst ORDER BY pos) FILTER (WHERE dst IS NOT NULL), []) AS d FROM (SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders UNION ALL SELECT -1) LEFT JOIN e ON idx = src GROUP BY idx) SELECT idx, CAST(to_json(list_resize(d, (SELECT max(len(d)) FROM g), -1)) AS VARCHAR) AS dsts FROM g")
def _(t):
    nodes = t.sql("SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders UNION ALL SELECT CAST(-1 AS BIGINT)")
    return R.padded_gather(nodes, t.sql(I.LINES)).select("idx", F.to_json("dsts").alias("dsts"))


@query("prj_last_non_negative", f"WITH g AS (SELECT l_orderkey AS idx, list(CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey AS BIGINT) ELSE -1 END ORDER BY line) AS d FROM ({I.LINE_ROWS}) GROUP BY 1) SELECT idx, coalesce(list_filter(d, lambda x: x >= 0)[-1], -1) AS last FROM g")
def _(t):
    masked = t.sql(I.LINE_ROWS).select(F.col("l_orderkey").alias("src"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).otherwise(F.lit(-1)).cast("long").alias("dst"), F.col("line").alias("pos"))
    return R.nest(masked).select(F.col("src").alias("idx"), R.last_non_negative(F.col("dsts")).alias("last"))


NEW = "SELECT CAST(o_orderkey AS BIGINT) AS src, CAST(o_custkey AS BIGINT) AS dst FROM orders WHERE o_orderkey % 5 = 0"


@query("prj_csr_insert", f"{L}, w AS ({NEW}) SELECT src, dst, pos FROM e UNION ALL SELECT src, dst, CAST(coalesce((SELECT max(pos) FROM e WHERE e.src = w.src), -1) + row_number() OVER (PARTITION BY src ORDER BY dst) AS INT) FROM w")
def _(t):
    return R.insert(t.sql(I.LINES), t.sql(NEW))


ADD = "SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS anchor_id, CAST(999999 AS BIGINT) AS entity FROM part GROUP BY 1 UNION ALL SELECT CAST(99 AS BIGINT), CAST(7 AS BIGINT)"


@query("prj_candidate_insert", f"WITH c AS ({I.CANDIDATES}), m AS (SELECT anchor_id, list_sort(list(cnt)) AS l, max(pos) AS e FROM c GROUP BY 1), a AS ({ADD}) SELECT anchor_id, entity, cnt, pos FROM c UNION ALL SELECT a.anchor_id, entity, coalesce(l[(len(l) - 1) // 2 + 1], 1), CAST(coalesce(e, -1) + 1 AS INT) FROM a LEFT JOIN m USING (anchor_id)")
def _(t):
    return R.insert_candidates(t.sql(I.CANDIDATES), t.sql(ADD))


@query("flt_offset_values_mask", f"{L} SELECT src, dst, pos, src % 2 = 0 AS active FROM e")
def _(t):
    return R.values_mask(t.sql(I.LINES), t.sql("SELECT o_orderkey AS idx FROM orders WHERE o_orderkey % 2 = 0"))


MASKED = f"SELECT CAST(l_orderkey AS BIGINT) AS src, CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE CAST(l_suppkey AS BIGINT) END AS dst, line AS pos FROM ({I.LINE_ROWS}) l"


@query("flt_remove_negatives", f"WITH e AS ({MASKED}) SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY pos) - 1 AS INT) AS pos FROM e WHERE dst >= 0")
def _(t):
    return R.remove_negatives(t.sql(MASKED)).select("src", "dst", F.col("pos").cast("int").alias("pos"))


MAPPING = "SELECT CAST(row_number() OVER (ORDER BY p_brand DESC) AS BIGINT) AS new_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS old_id FROM (SELECT DISTINCT p_brand FROM part) b"


@query("join_remap", f"WITH c AS ({I.CANDIDATES}), m AS ({MAPPING}) SELECT new_id AS anchor_id, entity, cnt, pos FROM m JOIN c ON old_id = anchor_id")
def _(t):
    return R.remap_rows(t.sql(MAPPING), t.sql(I.CANDIDATES))


RUNNING = "SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(sum(CASE WHEN o_custkey % 4 = 0 THEN o_custkey ELSE 0 END) OVER (ORDER BY o_orderkey) AS BIGINT) AS value FROM orders"


@query("prj_sparse_encode", f"WITH r AS ({RUNNING}), d AS (SELECT r.idx, r.value - coalesce(b.value, 0) AS delta FROM r LEFT JOIN r b ON b.idx + 1 = r.idx) SELECT idx, CAST(delta AS BIGINT) AS delta FROM d WHERE delta <> 0")
def _(t):
    return R.delta_encode(t.sql(RUNNING))


@query("prj_sparse_dense", RUNNING)
def _(t):
    deltas = t.sql("SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(o_custkey AS BIGINT) AS delta FROM orders WHERE o_custkey % 4 = 0")
    return R.delta_decode(deltas, t.sql(I.ORDER_IDS), 1 << 12)


LINKS = "SELECT CAST(l_orderkey AS BIGINT) AS src, 'Q' || CAST(l_suppkey AS STRING) AS qid FROM lineitem WHERE l_linenumber = 1"
KNOWN = "SELECT CAST(s_suppkey AS BIGINT) AS idx, 'Q' || CAST(s_suppkey AS STRING) AS qid FROM supplier WHERE s_suppkey % 3 <> 0"


@query("flt_link_resolve", f"WITH l AS ({LINKS}), k AS ({KNOWN}) SELECT src, qid, idx AS dst FROM l JOIN k USING (qid)")
def _(t):
    return R.resolve(t.sql(LINKS), t.sql(KNOWN))


@query("prj_link_to_ids", f"WITH l AS ({LINKS}), k AS ({KNOWN}) SELECT src, qid, coalesce(idx, -1) AS dst FROM l LEFT JOIN k USING (qid)")
def _(t):
    return R.resolve(t.sql(LINKS), t.sql(KNOWN), how="keep")


# sets --------------------------------------------------------------------------------------
EVEN, THIRD, RICH = ("SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders WHERE o_orderkey % 2 = 0", "SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders WHERE o_orderkey % 3 = 0", "SELECT CAST(l_orderkey AS BIGINT) AS idx FROM lineitem WHERE l_quantity > 40")


def _sets(t):
    return t.sql(EVEN), t.sql(THIRD), t.sql(RICH)


for _name in ("flt_bool_ors", "set_union"):
    query(_name, f"{EVEN} UNION {THIRD} UNION {RICH}")(lambda t: R.ors(*_sets(t)))
for _name in ("flt_bool_ands", "set_intersect"):
    query(_name, f"{EVEN} INTERSECT {THIRD} INTERSECT {RICH}")(lambda t: R.ands(*_sets(t)))
for _name in ("flt_bool_negate", "set_except"):
    query(_name, f"({EVEN} EXCEPT {THIRD}) EXCEPT {RICH}")(lambda t: R.negate(*_sets(t)))


@query("set_complement", f"{I.ORDER_IDS} EXCEPT {RICH}")
def _(t):
    return R.complement(t.sql(I.ORDER_IDS), t.sql(RICH))


@query("set_concat", "SELECT n_nationkey AS pos, n_name AS value, 0 AS dataset FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region")
def _(t):
    return R.concat(t.nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value")), t.region.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("value")))


@query("set_unique_ordered", "SELECT event_type AS value, min(event_id) AS pos FROM events GROUP BY 1")
def _(t):
    return R.unique_ordered(t.events.select(F.col("event_id").alias("pos"), F.col("event_type").alias("value")))


# attributes --------------------------------------------------------------------------------
@query("flt_attr_cmp", f"WITH a AS ({I.BIRTH}) SELECT 'lt' AS op, entity AS idx FROM a WHERE value < 1994 UNION ALL SELECT 'ge', entity FROM a WHERE value >= 1997 UNION ALL SELECT 'eq', entity FROM a WHERE value = 1995")
def _(t):
    a = t.sql(I.BIRTH)
    out = [R.compare(a, op, v).select(F.lit(name).alias("op"), "idx") for name, op, v in (("lt", "<", 1994), ("ge", ">=", 1997), ("eq", "==", 1995))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("prj_attr_dense", f"WITH a AS ({I.BIRTH}), n AS ({I.ORDER_IDS}) SELECT idx, coalesce(value, 0) AS value, entity IS NOT NULL AS present FROM n LEFT JOIN a ON idx = entity")
def _(t):
    return R.dense(t.sql(I.BIRTH), t.sql(I.ORDER_IDS))


@query("snk_sparse_attr", f"SELECT l_orderkey AS entity, arg_min(l_suppkey, line) AS value FROM ({I.LINE_ROWS}) WHERE l_returnflag = 'R' GROUP BY 1")
def _(t):
    lists = R.nest(t.sql(I.LINE_ROWS).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("line").alias("pos")))
    return R.first_value(lists.select(F.col("src").alias("entity"), F.col("dsts").alias("values")))
