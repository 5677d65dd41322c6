"""Queries of linking in text, report post-processing, sinks, hooks and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numeric as M
from tessera.operators import aggregates as A
from tessera.operators import linking as L
from tessera.sources import files as S
from tessera.sources import sinks
from tessera.storage import materialize, shared_folder
from tessera.streaming import counts as C

from . import inputs as I
from .registry import query

# a text of words between single spaces, some capitalised
TEXT = "SELECT p_partkey AS doc_id, 'we saw ' || p_brand || ' and ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' near ' || p_type || ' shop' AS text FROM part"
WORDS = f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, w[i] AS token, w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, '#', ' # '), ' ') AS w FROM ({TEXT})))"


def _tokens(t):
    return L.tokenize(t.sql(TEXT).withColumn("text", F.replace("text", F.lit("#"), F.lit(" # "))))


@query("str_tokenize", f"SELECT doc_id, pos, token FROM ({WORDS})")
def _(t):
    return _tokens(t).select("doc_id", F.col("pos").cast("int").alias("pos"), F.rtrim("raw").alias("token"))


ANCHORS = "SELECT anchor, CAST(min(anchor_id) AS BIGINT) AS anchor_id, CAST(sum(total) AS BIGINT) AS total FROM (SELECT lower(p_type) AS anchor, CAST(min(p_partkey) AS BIGINT) AS anchor_id, count(*) AS total FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT lower(split_part(p_name, ' ', 1)), CAST(100000 + min(p_partkey) AS BIGINT), count(*) FROM part GROUP BY 1 UNION ALL SELECT lower(p_name), CAST(200000 + min(p_partkey) AS BIGINT), count(*) FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) x GROUP BY 1"


@query("str_densify_match", f"""WITH w AS ({WORDS}), a AS ({ANCHORS}), g AS (SELECT doc_id, pos, n, lower(array_to_string(w[pos + 1:pos + n], ' ')) AS s FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS n FROM w) WHERE pos + n <= len(w) AND regexp_matches(token, '^[A-Z]')),
m AS (SELECT doc_id, pos, n, s, anchor_id FROM g JOIN a ON s = anchor WHERE length(s) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1)
SELECT doc_id, pos, n, anchor_id FROM m k WHERE anchor_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = k.doc_id AND o.pos < k.pos AND o.pos + o.n > k.pos AND o.anchor_id % 5 <> 0)""")
def _(t):
    a = t.sql(ANCHORS)
    return L.match_anchors(_tokens(t), a, a.where("anchor_id % 5 <> 0")).select("doc_id", F.col("pos").cast("int").alias("pos"), "n", "anchor_id")


def _page(t):
    tokens = _tokens(t).withColumn("linked", F.col("raw").rlike("^(near|#)"))
    # written first: the optimizer knows their sizes then, and deals no grams where they are small
    anchors = materialize(t.sql(ANCHORS), "anchors")
    candidates = anchors.select("anchor_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select("anchor_id", (F.col("anchor_id") % 7 + F.col("k")).alias("entity"), (F.col("anchor_id") % 5 + F.col("k")).cast("long").alias("cnt"))
    links = t.sql(TEXT).select("doc_id", F.explode(F.array(F.col("doc_id") % 7 + 1, F.col("doc_id") % 5 + 2)).alias("entity"))
    names = t.spark.range(20).select(F.col("id").alias("idx"), F.concat(F.lit("steel ring "), F.col("id").cast("string")).alias("name"))
    triggers = materialize(A.token_counts(tokens.select(F.lower(F.rtrim("raw")).alias("token"), F.lit(True).alias("is_label"))), "triggers")
    return L.link_features(tokens, anchors, candidates, links, names, triggers)


@query("str_densify_features")
def _(t):
    return _page(t)


@query("str_densify_link")
def _(t):
    return L.densify(_page(t), F.get("features", F.lit(5)) + F.get("features", F.lit(4)) / 4)


MARKED = "SELECT p_partkey AS doc_id, 'In [[' || p_brand || '|the ' || p_name || ']] and [[' || p_type || ']] too' AS text FROM part"


@query("str_annotate", "SELECT p_partkey AS doc_id, 3 AS start, 3 + 4 + length(p_name) AS stop, split_part(p_brand, '#', 1) AS link FROM part UNION ALL SELECT p_partkey, 12 + length(p_name), 12 + length(p_name) + length(p_type), p_type FROM part")
def _(t):
    return L.annotate(t.sql(MARKED))[1].select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "link")


def _placed(t):
    plain, tags = L.annotate(t.sql(MARKED))
    return L.with_places(L.tokenize(plain)), tags


@query("str_merge_tags", "SELECT p_partkey AS doc_id, 2 + len(string_split(p_name, ' ')) - 1 + len(string_split(p_type, ' ')) AS n FROM part")
def _(t):
    words, tags = _placed(t)
    return L.merge_tags(words, tags.withColumnRenamed("link", "tag")).where("tag is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("str_realign", "SELECT p_partkey AS doc_id, 1 + len(string_split(p_name, ' ')) AS pos, split_part(p_brand, '#', 1) AS label FROM part UNION ALL SELECT p_partkey, 2 + len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')), p_type FROM part")
def _(t):
    words, tags = _placed(t)
    return L.realign(words, tags.withColumnRenamed("link", "label"), last_only=True).select("doc_id", F.col("pos").cast("long").alias("pos"), "label")


def _u(k: int) -> str:
    return f"CAST('0x' || substr(md5(doc_id || ':' || pos || ':1:{k}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("str_dropout", f"WITH w AS ({WORDS}), a AS (SELECT doc_id, pos, CASE WHEN {_u(1)} < 0.3 THEN lower(token) ELSE token END AS t FROM w), b AS (SELECT doc_id, pos, CASE WHEN {_u(2)} < 0.3 AND ends_with(t, 's') THEN left(t, -1) ELSE t END AS t FROM a) SELECT doc_id, pos, CASE WHEN {_u(3)} < 0.1 THEN '' ELSE t END AS token FROM b")
def _(t):
    return L.dropout(_tokens(t), 0.3, 0.3, 0.1).select("doc_id", F.col("pos").cast("int").alias("pos"), F.rtrim("raw").alias("token"))


# post-processing ---------------------------------------------------------------------------
SPANS = "SELECT c_custkey AS doc_id, k AS pos, CASE k WHEN 1 THEN 'Result:' WHEN 2 THEN 'Team ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '(' END WHEN 3 THEN CASE WHEN c_custkey % 4 = 0 THEN 'French' ELSE 'Paris' END WHEN 4 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ') in 1995 ' END WHEN 5 THEN '(x)' ELSE 'Cup' END AS text, CASE WHEN k IN (3, 6) THEN c_custkey * 10 + k END AS mention_id FROM customer, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)"


def _spans(t):
    d, k = F.col("doc_id"), F.col("pos")
    text = F.when(k == 1, "Result:").when(k == 2, F.concat(F.lit("Team "), F.when(d % 3 == 0, "").otherwise("("))).when(k == 3, F.when(d % 4 == 0, "French").otherwise("Paris")).when(k == 4, F.when(d % 5 == 0, "").otherwise(") in 1995 ")).when(k == 5, "(x)").otherwise("Cup")
    rows = t.customer.select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pos"))
    return rows.select("doc_id", "pos", text.alias("text"), F.when(k.isin(3, 6), d * 10 + k).alias("mention_id"))


_CANDS = "SELECT mention_id, e AS entity, CASE e % 3 WHEN 0 THEN 'Cup 1994' WHEN 1 THEN 'Cup 1995' ELSE 'Cup' END AS name, ((mention_id * (e + 3)) % 31) / 31.0 AS prob, ((mention_id * (e + 5)) % 29) / 29.0 AS link_prob FROM s, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS e) WHERE mention_id IS NOT NULL"


def _cands(t):
    m, e = F.col("mention_id"), F.col("entity")
    rows = _spans(t).where("mention_id is not null").select("mention_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("entity"))
    rows = rows.select("mention_id", "entity", F.when(e % 3 == 0, "Cup 1994").when(e % 3 == 1, "Cup 1995").otherwise("Cup").alias("name"), (m * (e + 3) % 31 / 31.0).alias("prob"), (m * (e + 5) % 29 / 29.0).alias("link_prob"))
    return rows.withColumn("predicted", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("prob"), "entity")) == 1)


def _ids(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "entity int")


@query("post_parenthesis", f"WITH s AS ({SPANS}), c AS ({_CANDS}) SELECT mention_id, entity FROM c WHERE mention_id % 10 = 3 AND (mention_id // 10) % 3 <> 0 AND entity IN (2, 4) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY prob DESC, entity) = 1")
def _(t):
    return L.pick_in_parenthesis(_spans(t), _cands(t), _ids(t, 2, 4))


@query("post_dates", f"WITH s AS ({SPANS}), c AS ({_CANDS}), p AS (SELECT mention_id, entity FROM c QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY prob DESC, entity) = 1), w AS (SELECT mention_id FROM p WHERE entity IN (0, 1, 3)) SELECT mention_id, entity FROM c JOIN w USING (mention_id) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY (name = 'Cup' OR (name = 'Cup 1995' AND (mention_id // 10) % 5 <> 0)) DESC, prob DESC, entity) = 1")
def _(t):
    return L.pick_by_date(_spans(t), _cands(t), _ids(t, 0, 1, 3))


@query("post_nationality", f"WITH s AS ({SPANS}), c AS ({_CANDS}) SELECT mention_id, entity FROM c WHERE mention_id % 10 = 3 AND (mention_id // 10) % 4 = 0 AND entity IN (2, 4, 5) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY link_prob DESC, entity) = 1")
def _(t):
    return L.pick_nationality(_spans(t), _cands(t), _ids(t, 2, 4, 5))


# sinks -------------------------------------------------------------------------------------
def _path(t, name):
    return f"{shared_folder(t.spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query("snk_csr", f"SELECT prop, count(*) AS n, CAST(sum(src % 1000 + dst % 1000) AS BIGINT) AS h FROM ({I.EDGES}) GROUP BY 1")
def _(t):
    path, edges = _path(t, "edges"), t.sql(I.EDGES)
    sinks.write_edges(edges.where("prop = 'nation'"), path)
    sinks.write_edges(edges.where(F.col("prop").isin(sinks.missing_properties(t.spark, path, ["nation", "buyer", "located"]))), path)
    return t.spark.read.parquet(path).groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") % 1000 + F.col("dst") % 1000).alias("h"))


@query("snk_trie", f"SELECT anchor, anchor_id FROM ({ANCHORS}) WHERE starts_with(anchor, 'b')")
def _(t):
    path = _path(t, "trie")
    sinks.write_dimension(t.sql(ANCHORS).select("anchor", "anchor_id"), path)
    return sinks.with_prefix(t.spark, path, "b")


@query("snk_token_tsv", "SELECT user_id, count(*) AS n_tokens FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 4 = 0) > 0")
def _(t):
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("para"), F.col("event_id").alias("pos"), F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("token"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Q"), F.col("event_id").cast("string"))).alias("qid"), F.lit(None).cast("string").alias("context_qid"), F.lit(None).cast("long").alias("anchor_id"))
    path = _path(t, "tsv")
    sinks.write_token_tsv(rows, path)
    found = S.token_tsv(t.spark, path)
    return found.select(F.substring_index(F.get("tokens", F.lit(0))["token"], "_", -1).cast("long").alias("user_id"), F.size("tokens").cast("long").alias("n_tokens"))


@query("snk_html", "SELECT c_custkey AS doc_id, '<tr class=\"' || CASE WHEN c_custkey % 3 = c_nationkey % 3 THEN 'right' ELSE 'wrong' END || '\"><td>a&amp;b ' || c_name || '</td><td>' || (c_custkey % 3) || '</td><td>' || (c_nationkey % 3) || '</td></tr>' AS html FROM customer")
def _(t):
    return sinks.html_rows(t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("a&b "), F.col("c_name")).alias("text"), (F.col("c_custkey") % 3).cast("int").alias("predicted"), (F.col("c_nationkey") % 3).cast("int").alias("label")))


@query("snk_jobs_cache", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    make = lambda: t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    settings, inputs = {"what": "segments", "from": t.folder}, (f"{t.folder}/customer.parquet",)
    sinks.cached(t.spark, settings, make, inputs)
    return sinks.cached(t.spark, settings, make, inputs)


# hooks and settings ------------------------------------------------------------------------
query("udf_make_callable", "SELECT p_partkey AS k, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part")(
    lambda t: t.part.select(F.col("p_partkey").alias("k"), M.make_callable("tessera.functions.text:clean_title")(F.col("p_name")).alias("title"))
)


@query("udf_corpus_loader", "SELECT strpos(text, 'near') - 1 AS start, doc_id AS id FROM (" + TEXT + ")")
def _(t):
    load = M.make_callable({"function": "tessera.sources.files:query_docs"})
    q = F.array(F.struct(F.lit("near").alias("text"), F.lit("Q1").alias("entity")))
    return load(t.sql(TEXT).select(F.col("doc_id").alias("id"), F.col("text").alias("doc"), q.alias("queries"))).select("id", F.col("start").cast("long").alias("start"))


@query("udf_fix_destination", "SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_partkey END AS entity FROM part WHERE p_size % 5 <> 0")
def _(t):
    links = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("entity"), "p_size")
    return L.fix_destinations(links, lambda d: d.withColumn("entity", F.when(F.col("p_size") % 2 == 0, F.lit(1)).otherwise(F.col("entity"))).withColumn("keep", F.col("p_size") % 5 != 0)).select("doc_id", F.col("entity").cast("long").alias("entity"))


@query("hash_nested", "SELECT r_regionkey AS k, true AS same FROM region")
def _(t):
    same = M.nested_hash({"a": 1, "b": {"c": [1, 2], "d": None}}) == M.nested_hash({"b": {"d": None, "c": [1, 2]}, "a": 1}) != M.nested_hash({"a": 2})
    return t.region.select(F.col("r_regionkey").alias("k"), F.lit(same).alias("same"))


@query("src_config", "SELECT 'window' AS key, '10' AS value FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'name', 'x' FROM region WHERE r_regionkey = 0")
def _(t):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # a driver-side file, read on the driver
        file = Path(folder) / "config.json"
        file.write_text(json.dumps({"name": "x", "data_path": "corpus"}))
        found = S.load_config(str(file), {"window": 10})
        assert found.pop("data_path") == f"{folder}/corpus"
    return t.spark.createDataFrame([(k, str(v)) for k, v in found.items()], "key string, value string")


@query("arr_extend", f"SELECT src, CAST(to_json(d || [-1]) AS VARCHAR) AS d FROM (SELECT src, list(dst ORDER BY pos) AS d FROM ({I.LINES}) GROUP BY 1)")
def _(t):
    from tessera.operators.relations import nest

    return nest(t.sql(I.LINES)).select("src", F.to_json(F.array_append("dsts", F.lit(-1).cast("long"))).alias("d"))


# learned pooled states: given weights, folded over a document's steps -----------------------
VECS = "SELECT label AS doc_id, vec_id AS step, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT label, vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)"


def _vectors(t):
    return t.embeddings.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("step"), F.posexplode("embedding").alias("i", "x")).select("doc_id", "step", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("st_max_entities", f"SELECT doc_id, step, i, round(max(x) OVER (PARTITION BY doc_id, i ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS state FROM ({VECS})")
def _(t):
    before = Window.partitionBy("doc_id", "i").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return _vectors(t).select("doc_id", "step", "i", F.round(F.max("x").over(before), 6).alias("state"))


@query("st_max_post", f"SELECT doc_id, step, i, round(greatest(0, 2 * max(x) OVER (PARTITION BY doc_id, i ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.1), 6) AS state FROM ({VECS})")
def _(t):
    before = Window.partitionBy("doc_id", "i").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    pooled = F.max("x").over(before)
    return _vectors(t).select("doc_id", "step", "i", F.round(F.greatest(F.lit(0.0), 2 * pooled - 0.1), 6).alias("state"))


@query("st_lstm")
def _(t):
    from tessera.operators.decode import recurrent_state

    rows = t.embeddings.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("step"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return recurrent_state(rows, 64, seed=1)


# streams (an extension) --------------------------------------------------------------------
def _event_files(t):
    path = _path(t, "stream-in")
    t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("token")).repartition(3, "event_id").write.parquet(path)
    return C.read_files(t.spark, path, "event_id long, ts timestamp, user_id long, token string", 1)


@query("stream_anchor_counts", "SELECT event_type AS anchor, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id % 7 END AS entity, count(*) AS cnt FROM events GROUP BY 1, 2")
def _(t):
    rows = _event_files(t).select(F.col("token").alias("anchor"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 7).alias("entity"))
    return C.drain(C.anchor_counts(rows))


@query("stream_windowed_counts", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS token, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    found = C.drain(C.windowed_counts(_event_files(t), "ts", "1 hour", "10000 days"))
    return found.select(F.unix_timestamp("start").alias("start"), "token", "n")


@query("stream_gap_sessions", "WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def _(t):
    return C.drain(C.gap_sessions(_event_files(t), "ts", "30 minutes", "10000 days")).select("user_id", F.unix_micros("start").alias("start"), "n")
