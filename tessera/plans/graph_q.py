"""Queries of graph traversal, projections, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geo, graph as G

from . import inputs as I
from .registry import query

E = f"WITH RECURSIVE e AS ({I.EDGES}), n AS ({I.ENTITIES}), ring AS ({I.RING})"
SEEDS = "SELECT CAST(100 + n_nationkey AS BIGINT) AS idx FROM nation WHERE n_nationkey < 6"


@query("gr_successor_mask", f"{E} SELECT DISTINCT src AS idx FROM e WHERE dst BETWEEN 100 AND 105 AND NOT (src = 1001 OR src % 100 = 3)")
def _(t):
    edges = t.sql(I.EDGES).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    bad = edges.where("dst = 1001 OR dst % 100 = 3").select(F.col("dst").alias("child"), F.col("src").alias("ancestor"))
    return G.successors(edges, t.sql(SEEDS), bad)


@query("gr_multi_step", f"{E}, r(idx, step) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT ring.dst, step + 1 FROM r JOIN ring ON src = idx WHERE step < 30) SELECT idx, min(step) AS step FROM r GROUP BY idx")
def _(t):
    return G.reach(t.sql(I.RING), t.spark.createDataFrame([(0,)], "idx long"))


@query("gr_multi_step_bounded", f"{E}, r(idx, step) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT ring.dst, step + 1 FROM r JOIN ring ON src = idx WHERE step < 3 AND ring.dst <> 12 AND NOT (ring.src = 6 AND ring.dst = 7)) SELECT idx, min(step) AS step FROM r GROUP BY idx")
def _(t):
    make = t.spark.createDataFrame
    return G.reach(t.sql(I.RING), make([(3,)], "idx long"), 3, make([(12,)], "idx long"), make([(7, 6)], "child long, ancestor long"))


@query("gr_satisfy", f"{E}, r(idx) AS (SELECT CAST(1 AS BIGINT) UNION SELECT src FROM r JOIN e ON dst = idx WHERE src <> 107 AND prop IN ('located', 'nation', 'buyer')) SELECT idx FROM r")
def _(t):
    graph = G.Graph(t.sql(I.EDGES), bad_nodes=t.spark.createDataFrame([(107,)], "idx long"))
    return graph.satisfy(["located", "nation", "buyer"], [1])


@query("gr_neighborhood", f"{E}, r(root, node, step) AS (SELECT DISTINCT src, dst, 1 FROM ring UNION SELECT root, ring.dst, step + 1 FROM r JOIN ring ON src = node WHERE step < 3) SELECT DISTINCT root, node FROM r")
def _(t):
    return G.neighborhood(t.sql(I.RING), t.sql(I.RING_NODES), 3)


DICT = "SELECT CAST(n_nationkey AS BIGINT) AS idx FROM nation WHERE n_nationkey % 2 = 1"


@query("gr_neighborhood_coded", f"{E}, d AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS code FROM ({DICT})), r(root, node, step) AS (SELECT DISTINCT src, dst, 1 FROM ring UNION SELECT root, ring.dst, step + 1 FROM r JOIN ring ON src = node WHERE step < 2) SELECT DISTINCT root, code AS node FROM r JOIN d ON node = idx")
def _(t):
    return G.neighborhood(t.sql(I.RING), t.sql(I.RING_NODES), 2, G.dictionary_positions(t.sql(DICT)))


@query("gr_neighborhood_remap", f"{E}, r(root, node, step) AS (SELECT DISTINCT src, dst, 1 FROM ring UNION SELECT root, ring.dst, step + 1 FROM r JOIN ring ON src = node WHERE step < 2) SELECT DISTINCT root, node FROM r WHERE node % 2 = 1")
def _(t):
    coded = G.dictionary_positions(t.sql(DICT))
    return G.codes_to_ids(G.neighborhood(t.sql(I.RING), t.sql(I.RING_NODES), 2, coded), coded)


@query("gr_find_dictionary", f"{E}, a AS (SELECT dst AS idx, count(*) AS n FROM e WHERE src >= 10000000 GROUP BY dst), b AS (SELECT dst AS idx, count(*) AS n FROM e WHERE src IN (SELECT idx FROM a) GROUP BY dst) SELECT idx, CAST(sum(n) AS BIGINT) AS n FROM (FROM a UNION ALL FROM b) GROUP BY idx")
def _(t):
    return G.find_dictionary(t.sql(I.EDGES), t.sql(I.ENTITIES).where("idx >= 10000000"), 2)


@query("gr_projection_catalog", f"{E}, c AS (SELECT dst AS idx, count(*) AS n FROM e WHERE prop = 'nation' GROUP BY dst), c2 AS (SELECT dst AS idx, count(*) AS n FROM e WHERE prop = 'buyer' GROUP BY dst) SELECT 'nation' AS projection, src AS root, dst AS node FROM e WHERE prop = 'nation' AND dst IN (SELECT idx FROM c WHERE n > 60) UNION ALL SELECT 'buyer', src, dst FROM e WHERE prop = 'buyer' AND dst IN (SELECT idx FROM c2 WHERE n > 12) UNION ALL SELECT 'place', src, dst FROM e WHERE prop = 'located' AND dst IN (1, 2)")
def _(t):
    graph, roots = G.Graph(t.sql(I.EDGES)), t.sql(I.ENTITIES)
    some = t.spark.createDataFrame([(1,), (2,)], "idx long")
    specs = {"nation": {"relations": ["nation"], "max_steps": 1, "min_count": 60}, "buyer": {"relations": ["buyer"], "max_steps": 1, "min_count": 12}, "place": {"relations": ["located"], "max_steps": 1, "condition": some}}
    out = None
    for name, spec in specs.items():
        one = G.project(graph, roots, spec).select(F.lit(name).alias("projection"), "root", "node")
        out = one if out is None else out.union(one)
    return out


_PATHS = f"{E}, p(idx, hops, path) AS (SELECT CAST(0 AS BIGINT), 0, '0' UNION ALL SELECT ring.dst, hops + 1, path || ' next ' || CAST(ring.dst AS VARCHAR) FROM p JOIN ring ON src = idx WHERE hops < 12 AND NOT list_contains(string_split(path, ' '), CAST(ring.dst AS VARCHAR)))"


@query("gr_path", f"{_PATHS} SELECT idx, min(hops) AS hops FROM p WHERE idx IN (SELECT idx FROM ({DICT})) GROUP BY idx")
def _(t):
    found = G.shortest_paths(t.sql(I.RING).select("src", "dst", F.lit(0).alias("rel"), F.lit("next").alias("prop"), "pos"), 0, t.sql(DICT))
    return found.select("idx", "hops")


NAMES = "SELECT CAST(n_nationkey AS BIGINT) AS idx, n_name AS name FROM nation"


@query("gr_describe", f"""WITH RECURSIVE ring AS ({I.RING}), n AS ({NAMES}), p(idx, hops, rank, text) AS (SELECT idx, 0, '', name FROM n WHERE idx = 0
UNION ALL SELECT dst, hops + 1, rank || pos, text || ' --next-> ' || coalesce(name, CAST(dst AS VARCHAR)) FROM p JOIN ring ON src = p.idx LEFT JOIN n ON n.idx = dst WHERE hops < 12),
b AS (SELECT idx, text FROM p QUALIFY row_number() OVER (PARTITION BY idx ORDER BY hops, rank) = 1) SELECT idx, text FROM b WHERE idx IN ({DICT})""")
def _(t):
    found = G.shortest_paths(t.sql(I.RING).select("src", "dst", F.lit(0).alias("rel"), F.lit("next").alias("prop"), "pos"), 0, t.sql(DICT))
    return G.describe(found, t.sql(NAMES))


@query("gr_extend_cursor", f"{E}, one AS (SELECT DISTINCT 'single' AS use, dst AS idx FROM ring WHERE src IN (3, 4)), r(idx, step) AS (SELECT DISTINCT dst, 1 FROM ring WHERE src IN (3, 4) UNION SELECT ring.dst, step + 1 FROM r JOIN ring ON src = idx WHERE step < 3) SELECT use, idx FROM one UNION ALL SELECT DISTINCT 'recursive', idx FROM r")
def _(t):
    start = t.spark.createDataFrame([(3,), (4,)], "idx long")
    ring = t.sql(I.RING)
    return G.extend_cursor(ring, start).select(F.lit("single").alias("use"), "idx").union(G.extend_cursor(ring, start, 3).select(F.lit("recursive").alias("use"), "idx"))


QIDS = "SELECT CAST(n_nationkey AS BIGINT) AS idx, n_name AS qid FROM nation"


@query("gr_blacklist", "SELECT 'node' AS kind, CAST(n_nationkey AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM nation WHERE n_nationkey IN (2, 5) UNION ALL SELECT 'pair', 1, 3 FROM region WHERE r_regionkey = 0")
def _(t):
    entities = t.sql(QIDS)
    name = {r.idx: r.qid for r in entities.where("idx < 8").collect()}  # eight rows
    nodes = t.spark.createDataFrame([(name[2],), (name[5],), ("no such name",)], "qid string")
    pairs = t.spark.createDataFrame([(name[1], name[3]), (name[1], "no such name")], "child_qid string, ancestor_qid string")
    kinds = G.blacklist(nodes, entities).select(F.lit("node").alias("kind"), F.col("idx").alias("a"), F.lit(None).cast("long").alias("b"))
    return kinds.union(G.blacklist_pairs(pairs, entities).select(F.lit("pair"), "child", "ancestor"))


def _classes(t):
    c = t.customer.select(F.col("c_custkey").alias("idx"), "c_mktsegment", "c_acctbal")
    return {"segment": c.where("c_mktsegment = 'BUILDING'"), "rich": c.where("c_acctbal > 5000"), "poor": c.where("c_acctbal < 0")}


_CLASSES = "SELECT c_custkey AS idx, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal < 0 THEN 0 ELSE 3 END AS class_id FROM customer"
for _name in ("gr_user_classifier", "gr_export_class", "snk_classification", "udf_classify_module"):
    query(_name, _CLASSES)(lambda t: G.classify(t.customer.select(F.col("c_custkey").alias("idx")), _classes(t))[0])


TITLES = """
SELECT 'enwiki' AS wiki, title, CAST(row_number() OVER (ORDER BY title) AS BIGINT) AS idx FROM (
  SELECT DISTINCT p_brand AS title FROM part UNION SELECT 'Category:' || p_brand || ' (goods)' FROM part
  UNION SELECT DISTINCT 'Category:' || p_type FROM part UNION SELECT replace(p_type, 'S', 's') || 's' FROM part WHERE p_size < 5 UNION SELECT DISTINCT 'Category:' || replace(p_type, 'S', 's') || 's' FROM part UNION SELECT DISTINCT p_type FROM part
  UNION SELECT 'crisis' FROM region UNION SELECT 'Category:crises' FROM region UNION SELECT 'city' FROM region UNION SELECT 'Category:cities' FROM region) t
"""


@query("prj_fixed_point", rf"""
WITH t AS ({TITLES}), c AS (SELECT idx AS category, substr(title, 10) AS name FROM t WHERE starts_with(title, 'Category:')),
a AS (SELECT category, name AS title, 0 AS n FROM c UNION ALL
  SELECT category, CASE WHEN ends_with(name, ')') THEN regexp_replace(name, '\s*\([^(]*\)$', '') WHEN ends_with(name, 'ses') THEN substr(name, 1, length(name) - 2) || 'is' WHEN ends_with(name, 'ies') THEN substr(name, 1, length(name) - 3) || 'y' WHEN ends_with(name, 's') THEN substr(name, 1, length(name) - 1) END, 1 FROM c)
SELECT category, arg_min(idx, n) AS article FROM a JOIN t USING (title) GROUP BY category""")
def _(t):
    return G.fixed_points(t.sql(TITLES), "enwiki")


# geography ---------------------------------------------------------------------------------
@query("geo_distance", f"WITH p AS ({I.PLACES}), h AS (SELECT idx, pow(sin(radians(lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(lat)) * pow(sin(radians(lon - 2.3522) / 2), 2) AS a FROM p) SELECT idx, round(6371 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM h")
def _(t):
    return t.sql(I.PLACES).select("idx", F.round(geo.distance(F.col("lat"), F.col("lon"), 48.8566, 2.3522), 6).alias("km"))


_POLY = ((10.0, -20.0), (60.0, -30.0), (70.0, 40.0), (20.0, 60.0), (35.0, 10.0))


def _crossings():
    out = []
    for (a, b), (c, d) in zip(_POLY, (*_POLY[1:], _POLY[0])):
        out.append(f"CASE WHEN ({b} > lon) <> ({d} > lon) AND lat < ({c} - {a}) * (lon - {b}) / ({d} - {b}) + {a} THEN 1 ELSE 0 END")
    return " + ".join(out)


@query("geo_inside_polygon", f"WITH p AS ({I.PLACES}) SELECT idx, ({_crossings()}) % 2 = 1 AS inside FROM p")
def _(t):
    return t.sql(I.PLACES).select("idx", geo.inside(F.col("lat"), F.col("lon"), _POLY).alias("inside"))


@query("geo_continents", f"WITH p AS ({I.PLACES}) SELECT 'box' AS name, idx FROM p WHERE lon BETWEEN -10.5 AND 40.5 AND lat BETWEEN 35.5 AND 71.5 UNION ALL SELECT 'south', idx FROM p WHERE lat < -60.5")
def _(t):
    shapes = t.spark.createDataFrame([("box", [(35.5, -10.5), (71.5, -10.5), (71.5, 40.5), (35.5, 40.5)]), ("south", [(-91.0, -181.0), (-60.5, -181.0), (-60.5, 181.0), (-91.0, 181.0)])], geo.POLYGONS)
    return geo.containing(t.sql(I.PLACES), shapes)


FIXED = "SELECT CAST(c_custkey AS BIGINT) AS idx, CASE WHEN c_custkey % 4 <> 0 THEN CAST(((c_custkey * 37) % 181 - 90) * 10000000 AS INT) END AS lat, CASE WHEN c_custkey % 4 <> 0 THEN CAST(((c_custkey * 53) % 361 - 180) * 10000000 AS INT) END AS lon FROM customer"


@query("geo_unit_vector", f"WITH f AS ({FIXED}) SELECT idx, round(coalesce(cos(radians(lat / 1e7)) * cos(radians(lon / 1e7)), 0), 9) AS x, round(coalesce(cos(radians(lat / 1e7)) * sin(radians(lon / 1e7)), 0), 9) AS y, round(coalesce(sin(radians(lat / 1e7)), 0), 9) AS z, lat IS NOT NULL AND lon IS NOT NULL AS present FROM f")
def _(t):
    v = geo.unit_vector(F.col("lat"), F.col("lon"))
    return t.sql(FIXED).select("idx", v.alias("v")).select("idx", F.round("v.x", 9).alias("x"), F.round("v.y", 9).alias("y"), F.round("v.z", 9).alias("z"), "v.present")
