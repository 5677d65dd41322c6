"""Inputs that queries derive from the driver tables, as SQL that Spark and DuckDB both read.

Typed entity ids: region r, nation 100 + n, supplier 1000 + s, customer 10 million + c,
order 100 million + o, part 2 billion + p.
"""

EDGES = """
SELECT 'located' AS prop, CAST(100 + n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, 0 AS pos FROM nation
UNION ALL SELECT 'nation', CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), 0 FROM supplier
UNION ALL SELECT 'nation', CAST(10000000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), 0 FROM customer
UNION ALL SELECT 'buyer', CAST(100000000 + o_orderkey AS BIGINT), CAST(10000000 + o_custkey AS BIGINT), 0 FROM orders
"""
ENTITIES = """
SELECT CAST(r_regionkey AS BIGINT) AS idx FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT) FROM customer
UNION ALL SELECT CAST(100000000 + o_orderkey AS BIGINT) FROM orders
"""
#: Lines in a total order inside their order (line numbers repeat).
LINE_ROWS = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line
FROM lineitem
"""
#: A multiset relation with several targets a source: an order's suppliers by line.
LINES = f"SELECT CAST(l_orderkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, line AS pos FROM ({LINE_ROWS}) l"
#: A cyclic relation: the nations' ring, and each nation to its double.
RING = """
SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst, 0 AS pos FROM nation WHERE n_nationkey % 5 <> 4
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey * 2) % 25 AS BIGINT), 1 FROM nation WHERE n_nationkey % 3 = 0
"""
RING_NODES = "SELECT CAST(n_nationkey AS BIGINT) AS idx FROM nation"
#: Anchor candidates: a part's suppliers; the quantity that its lines take from one is how often they link it.
CANDIDATES = """
SELECT anchor_id, entity, cnt, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY entity) - 1 AS INT) AS pos FROM (
  SELECT CAST(l_partkey AS BIGINT) AS anchor_id, CAST(l_suppkey AS BIGINT) AS entity, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY l_partkey, l_suppkey) c
"""
#: Each supplier's class: its nation's region; region 4 counts as "other".
SUPPLIER_CLASS = "SELECT CAST(s_suppkey AS BIGINT) AS entity, CAST(n_regionkey AS INT) AS class_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"
#: Mentions: an order's lines are its mentions, the part is the anchor, the supplier the label.
MENTIONS = f"""
SELECT CAST(l_orderkey * 1000000 + line AS BIGINT) AS mention_id, CAST(l_orderkey AS BIGINT) AS doc_id, CAST(line AS BIGINT) AS step,
       CAST(l_partkey AS BIGINT) AS anchor_id, CAST(l_suppkey AS BIGINT) AS label
FROM ({LINE_ROWS}) l
"""
#: Sparse attributes of orders: absent where the key does not divide.
ATTRIBUTES = """
SELECT 'birth' AS prop, CAST(o_orderkey AS BIGINT) AS entity, CAST(year(o_orderdate) AS INT) AS value FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'inception', CAST(o_orderkey AS BIGINT), CAST(year(o_orderdate) - o_orderkey % 7 AS INT) FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'death', CAST(o_orderkey AS BIGINT), CAST(year(o_orderdate) + 60 AS INT) FROM orders WHERE o_orderkey % 4 = 0
"""
BIRTH = "SELECT CAST(o_orderkey AS BIGINT) AS entity, CAST(year(o_orderdate) AS INT) AS value FROM orders WHERE o_orderkey % 3 <> 0"
ORDER_IDS = "SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders"
#: Coordinates by rule from the key; some customers have none.
PLACES = """
SELECT CAST(c_custkey AS BIGINT) AS idx, CAST((c_custkey * 37) % 181 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) AS lon
FROM customer WHERE c_custkey % 4 <> 0
"""
#: Event streams as token rows: a user's events in time order; the type is the token, a purchase is a label.
STEPS = """
SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_type AS token,
       CASE WHEN event_id % 7 = 0 THEN event_id % 5 END AS anchor_id, value
FROM events
"""


def offers(t):
    """``CANDIDATES``: the lines are dealt by part once, so sums, places and whatever goes by anchor after them deal nothing again."""
    return t.sql(CANDIDATES, lineitem=t.lineitem.select("l_partkey", "l_suppkey", "l_quantity").repartition("l_partkey"))
