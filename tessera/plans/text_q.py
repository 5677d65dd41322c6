"""Queries of text functions, title resolution and sources (files are written from the driver tables first)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import titles as R
from tessera.sources import files as S
from tessera.storage import shared_folder

from .registry import query

ARTICLES = """
SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS title,
       'Intro [[' || p_brand || ']] and [[' || p_type || '#sec|' || p_name || ']] text [[ |x]] [[File:a.png]] [[Category:' || p_brand || '|x]] [[Catégorie:' || p_type || '#top]]'
       || CASE WHEN p_partkey % 7 = 0 THEN ' #redirect  [[' || p_type || '#a|b]]' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' #REDIRECT [[<iframe x]]' ELSE '' END AS text
FROM part
UNION ALL SELECT 'Help: ' || n_name, 'See [[x]]' FROM nation
"""
_LINK = r"CASE WHEN contains(m, '|') THEN split_part(trim(regexp_replace(m, '\|[^|]*$', '')), '#', 1) ELSE m END"


def _found(pattern: str, out: str) -> str:
    return f"SELECT title, {out} FROM (SELECT title, trim(unnest(regexp_extract_all(text, '{pattern}', 1))) AS m FROM ({ARTICLES}))"


@query("str_extract_categories", "SELECT title, link FROM (" + _found(r"\[\[((?:Category:|Catégorie:|Categorie:|Categoría:|Categoria:|Kategorie:|Kategoria:|Категория:|Kategori:)[^\]\[]*)\]\]", f"{_LINK} AS link") + ") WHERE link <> ''")
def _(t):
    return t.sql(ARTICLES).select("title", F.explode(T.categories(F.col("text"))).alias("link"))


@query("str_extract_redirects", "SELECT title, link FROM (" + _found(r"(?i)(?:#REDIRECT|#weiterleitung|#REDIRECCIÓN|REDIRECIONAMENTO)\s*\[\[([^\]\[]*)\]\]", f"{_LINK} AS link") + ") WHERE link <> '' AND NOT contains(link, '<iframe')")
def _(t):
    return t.sql(ARTICLES).select("title", F.explode(T.redirects(F.col("text"))).alias("link"))


_ANCHORS = "SELECT title, link, anchor FROM (" + _found(r"\[\[([^\]\[:]*)\]\]", f"{_LINK} AS link, trim(split_part(m, '|', -1)) AS anchor") + ") WHERE link <> '' AND anchor <> ''"


@query("str_extract_anchors", _ANCHORS)
def _(t):
    return t.sql(ARTICLES).select("title", F.inline(T.anchors(F.col("text"))))


@query("str_self_anchor", f"WITH a AS ({_ANCHORS}) SELECT title AS context, title AS anchor, title AS target FROM ({ARTICLES}) WHERE NOT contains(title, ':') UNION ALL SELECT title, anchor, link FROM a WHERE NOT contains(title, ':')")
def _(t):
    return T.article_anchors(t.sql(ARTICLES))


@query("str_links")
def _(t):
    return t.sql(ARTICLES).select("title", F.posexplode(T.spans(F.col("text"))).alias("n", "s")).select("title", "n", F.col("s.text").alias("text"), F.col("s.link").alias("link"))


@query("flt_bad_link", f"SELECT title FROM ({ARTICLES}) WHERE starts_with(title, 'Help:')")
def _(t):
    return t.sql(ARTICLES).where(T.bad_title(F.col("title"))).select("title")


@query("str_strip_markup")
def _(t):
    return t.sql(ARTICLES).select("title", T.by_batch(T.strip_markup)("text").alias("text"))


@query("str_html_text")
def _(t):
    return t.pages.select("page_id", T.by_batch(T.html_text)("html").alias("text"))


WORDS = "SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM benchmark"
RAW = "SELECT CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'The (' || p_name || ')' WHEN 1 THEN 'l''' || p_name WHEN 2 THEN p_name || '''s' WHEN 3 THEN 'of the ' || p_brand || ' ' WHEN 4 THEN p_type || ',' WHEN 5 THEN '[The] ' || p_name || ' and' WHEN 6 THEN '12th' ELSE CAST(p_size AS STRING) || '/3' END AS anchor, p_partkey AS k FROM part"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(T.STOP_WORDS)) + "]"
CLEAN = rf"""
WITH r AS ({RAW}), a AS (SELECT k, regexp_replace(regexp_replace(rtrim(anchor), '^[()\[\]]+', ''), '[()\[\]]+$', '') AS s FROM r),
b AS (SELECT k, CASE WHEN regexp_matches(s, '^['',\-!.?:’]') OR regexp_matches(s, '['',\-!?:’]$') THEN '' ELSE s END AS s FROM a),
c AS (SELECT k, list_filter(string_split_regex(regexp_replace(regexp_replace(s, '^[lLdDjJtT]''', ''), '''s$', ''), '\s+'), lambda w: w <> '') AS w FROM b),
d AS (SELECT k, w, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains({_STOPS}, lower(x)) THEN -1 ELSE i END), lambda i: i >= 0) AS p FROM c)
SELECT k, lower(substr(coalesce(array_to_string(CASE WHEN len(p) > 0 THEN w[p[1]:p[-1]] ELSE [] END, ' '), ''), 1, 256)) AS anchor FROM d
"""


@query("str_clean_anchor", CLEAN)
def _(t):
    return t.sql(RAW).select("k", T.clean_anchor(F.col("anchor")).alias("anchor"))


@query("str_ordinal", rf"SELECT k, regexp_matches(anchor, '^\d+(st|th|nd|rd|er|eme|ème|ère)$') AS ordinal, regexp_matches(anchor, '^\d+([\/\-,\.:;%]\d*)+$') AS numbers FROM ({RAW})")
def _(t):
    return t.sql(RAW).select("k", T.is_ordinal(F.col("anchor")).alias("ordinal"), T.is_number_punctuation(F.col("anchor")).alias("numbers"))


KNOWN = "SELECT DISTINCT lower(p_name) AS anchor FROM part UNION SELECT '12th' FROM region UNION SELECT lower(p_brand) FROM part"


@query("flt_acceptable_anchor", rf"SELECT k, anchor FROM ({CLEAN}) WHERE anchor <> '' AND NOT regexp_matches(anchor, '^\d+$') AND NOT regexp_matches(anchor, '^\d+(st|th|nd|rd|er|eme|ème|ère)$') AND NOT regexp_matches(anchor, '^\d+([\/\-,\.:;%]\d*)+$') AND anchor IN ({KNOWN}) AND anchor <> 'brand#11'")
def _(t):
    bad = t.spark.createDataFrame([("brand#11",)], "anchor string")
    return R.acceptable_anchors(t.sql(RAW).select("k", T.clean_anchor(F.col("anchor")).alias("anchor")), t.sql(KNOWN), bad).select("k", "anchor")


@query("flt_has_prefix", "WITH k AS (SELECT DISTINCT p_type AS key FROM part), p AS (SELECT DISTINCT substr(p_type, 1, 8) AS prefix FROM part UNION SELECT split_part(p_type, ' ', 1) FROM part) SELECT prefix, EXISTS (SELECT 1 FROM k WHERE key = prefix OR starts_with(key, prefix || ' ')) AS found FROM p")
def _(t):
    return R.has_prefix(t.sql("SELECT DISTINCT substr(p_type, 1, 8) AS prefix FROM part UNION SELECT split_part(p_type, ' ', 1) FROM part"), t.part.select(F.col("p_type").alias("key")).distinct())


TITLES = "SELECT 'enwiki' AS wiki, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title, CAST(min(p_partkey) AS BIGINT) AS idx FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT 'frwiki', p_type, CAST(0 AS BIGINT) FROM part WHERE p_partkey = 1"
REDIRECTS = "SELECT lower(p_type) || ' old' AS source, lower(p_type) || '#x' AS target FROM part GROUP BY 1, 2"
DESTS = "SELECT p_partkey AS k, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) WHEN 1 THEN replace(lower(p_type), ' ', '_') || '#sec' WHEN 2 THEN lower(p_type) || '_old' ELSE p_name END AS dest FROM part"


def _clean(x: str) -> str:
    return f"replace(split_part(upper(substr({x}, 1, 1)) || substr({x}, 2), '#', 1), '_', ' ')"


RESOLVED = f"""
WITH t AS (SELECT title, idx FROM ({TITLES}) WHERE wiki = 'enwiki'), d AS (SELECT k, dest, {_clean("dest")} AS c FROM ({DESTS})),
r AS (SELECT upper(substr(source, 1, 1)) || substr(source, 2) AS s, max({_clean("target")}) AS h FROM ({REDIRECTS}) GROUP BY 1)
SELECT k, dest, coalesce(t1.idx, t2.idx, t3.idx) AS idx FROM d LEFT JOIN t t1 ON dest = t1.title LEFT JOIN t t2 ON c = t2.title LEFT JOIN r ON c = s LEFT JOIN t t3 ON h = t3.title
"""


@query("join_title_resolve", RESOLVED)
def _(t):
    return R.resolve(t.sql(DESTS), t.sql(TITLES), t.sql(REDIRECTS), "enwiki")


@query("str_cleanup_title", f"SELECT k, {_clean('dest')} AS title FROM ({DESTS})")
def _(t):
    return t.sql(DESTS).select("k", T.clean_title(F.col("dest")).alias("title"))


@query("join_anchor_resolve", f"WITH x AS ({RESOLVED}) SELECT CAST(k AS VARCHAR) AS context, 'a' || CAST(k AS VARCHAR) AS anchor, idx FROM x WHERE idx IS NOT NULL")
def _(t):
    rows = t.sql(DESTS).select(F.col("k").cast("string").alias("context"), F.concat(F.lit("a"), F.col("k").cast("string")).alias("anchor"), F.col("dest").alias("target"))
    long = rows.limit(0).union(t.spark.createDataFrame([("c", "x" * 300, "Standard")], "context string, anchor string, target string"))
    return R.resolve_anchors(rows.union(long), t.sql(TITLES), t.sql(REDIRECTS), "enwiki")


CATEGORIES = "SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS article, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_name END AS category FROM part"


@query("join_category_links", f"WITH t AS (SELECT title, idx FROM ({TITLES}) WHERE wiki = 'enwiki'), c AS ({CATEGORIES}) SELECT a.idx AS src, coalesce(b.idx, d.idx) AS dst FROM c JOIN t a ON article = a.title LEFT JOIN t b ON category = b.title LEFT JOIN t d ON upper(substr(category, 1, 1)) || substr(category, 2) = d.title WHERE coalesce(b.idx, d.idx) IS NOT NULL")
def _(t):
    return R.category_links(t.sql(CATEGORIES), t.sql(TITLES), "enwiki")[0]


@query("join_aida_means", f"WITH x AS ({RESOLVED}), c AS ({CLEAN}) SELECT DISTINCT anchor, idx FROM c JOIN x USING (k) WHERE idx IS NOT NULL AND anchor <> '' AND NOT regexp_matches(anchor, '^[0-9]') AND anchor IN ({KNOWN})")
def _(t):
    rows = t.sql(RAW).join(t.sql(DESTS), "k").select(F.concat(F.lit('"'), F.col("anchor"), F.lit('"')).alias("mention"), "dest")
    return R.means(rows, t.sql(KNOWN), t.sql(TITLES), t.sql(REDIRECTS), "enwiki")


STALE = "SELECT CAST(l_orderkey * 1000 + l_suppkey AS BIGINT) AS anchor_id, CAST(l_suppkey AS BIGINT) AS old FROM lineitem GROUP BY 1, 2"


@query("join_transition", f"SELECT anchor_id, old, CASE WHEN CASE WHEN old % 3 = 0 THEN old + 1 ELSE old END % 2 = 0 THEN CASE WHEN old % 3 = 0 THEN old + 1 ELSE old END END AS idx FROM ({STALE})")
def _(t):
    stale = t.sql(STALE)
    moves = stale.where("old % 3 = 0").select("anchor_id", "old", (F.col("old") + 1).alias("new"))
    options = stale.select("anchor_id", F.when(F.col("old") % 3 == 0, F.col("old") + 1).otherwise(F.col("old")).alias("entity")).where("entity % 2 = 0")
    return R.transition(stale, moves, options)


@query("str_asciify", f"SELECT doc_id, md5(translate(replace(text, 'i̇', 'i'), '{T.PLAIN_FROM}', '{T.PLAIN_TO}')) AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.plain_letters(F.col("text"))).alias("plain"))


@query("str_wiki_prefix", "SELECT lang, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang || 'wiki' END AS wiki FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'xx')")
def _(t):
    langs = t.documents.select("lang").union(t.spark.createDataFrame([("xx",)], "lang string")).distinct()
    return langs.select("lang", T.wiki_prefix(F.concat("lang", F.lit("wiki"))).alias("wiki"))


@query("str_percent", "SELECT p_partkey AS k, round(CASE WHEN strpos(p_type, 'STEEL') > 0 THEN (strpos(p_type, 'STEEL') - 1) / length(p_type)::DOUBLE ELSE 1 END, 9) AS before, round(CASE WHEN strpos(p_type, 'STEEL') > 0 THEN (length(p_type) - strpos(p_type, 'STEEL') + 1 - 5) / length(p_type)::DOUBLE ELSE 1 END, 9) AS after FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k"), F.round(T.percent_before(F.col("p_type"), F.lit("STEEL")), 9).alias("before"), F.round(T.percent_after(F.col("p_type"), F.lit("STEEL")), 9).alias("after"))


@query("str_parse_year", "SELECT o_orderkey AS k, CAST(year(o_orderdate) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS INTEGER) AS year FROM orders")
def _(t):
    stamp = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return t.orders.select(F.col("o_orderkey").alias("k"), T.parse_year(stamp).alias("year"))


@query("num_fixed_latlong", "SELECT c_custkey AS k, CAST(trunc(c_acctbal / 100 * 1e7) AS INTEGER) AS fixed FROM customer")
def _(t):
    from tessera.operators import geo

    return t.customer.select(F.col("c_custkey").alias("k"), geo.fixed_degrees(F.col("c_acctbal") / 100).alias("fixed"))


@query("str_state_abbrev", "SELECT n_name AS name, CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' ELSE n_name END AS full_name FROM nation")
def _(t):
    short = t.spark.createDataFrame([("NATION_1", "One"), ("NATION_2", "Two")], "name string, long string")
    return t.nation.select(F.col("n_name").alias("name")).join(F.broadcast(short), "name", "left").select("name", F.coalesce("long", "name").alias("full_name"))


@query("str_features", "SELECT p_partkey AS k, right(p_brand, 3) AS suffix, left(p_brand, 3) AS prefix, lower(p_brand) AS lower, regexp_matches(p_brand, '^[0-9]+$') AS is_digit, length(regexp_replace(p_brand, '[A-Za-z0-9]', '', 'g')) AS n_punctuation, regexp_matches(p_brand, '^[A-Z]') AS first_upper FROM part")
def _(t):
    f = T.token_features(F.col("p_brand"))
    return t.part.select(F.col("p_partkey").alias("k"), f.alias("f")).select("k", "f.suffix", "f.prefix", "f.lower", "f.is_digit", F.col("f.n_punctuation").cast("long").alias("n_punctuation"), "f.first_upper")


@query("str_byte_features", "WITH h AS (SELECT doc_id, hex(encode(substr(text, 1, 6))) AS h FROM documents), b AS (SELECT doc_id, [255] || list_transform(range(0, least(length(h) // 2, 6)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INT)) || [256] AS b FROM h) SELECT doc_id, array_to_string(list_resize(b, 8, -1), ',') AS bytes FROM b")
def _(t):
    return t.documents.select("doc_id", F.array_join(T.token_features(F.col("text")).getField("bytes"), ",").alias("bytes"))


# sources -----------------------------------------------------------------------------------
def _text(t, rows, name: str, files: int | None = 1) -> str:
    path = f"{shared_folder(t.spark)}/tessera/src-{uuid.uuid4().hex}/{name}"
    (rows.coalesce(files) if files else rows).write.text(path)
    return path


KG_LINES = """
SELECT n_nationkey AS k, '{"id":"Q' || CAST(n_nationkey AS STRING) || '","sitelinks":{"enwiki":{"title":"' || n_name || '"},"enwikiquote":{"title":"x"}},"claims":{"P17":[{"mainsnak":{"datavalue":{"value":{"id":"Q' || CAST(100 + n_regionkey AS STRING)
  || '"}}}},{"mainsnak":{}}],"P569":[{"mainsnak":{"datavalue":{"value":{"time":"+18' || CAST(10 + n_nationkey AS STRING) || '-01-02T00:00:00Z"}}}}]}},' AS value FROM nation
"""


def _kg(t):
    lines = t.sql(KG_LINES).orderBy("k").select("value")
    opened = t.spark.createDataFrame([("[",)], "value string")
    return S.kg_json(t.spark, _text(t, opened.union(lines.coalesce(1)), "kg.json"))


@query("src_kg_json", "SELECT CAST(n_nationkey AS BIGINT) AS idx, 'Q' || CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def _(t):
    return _kg(t).select("idx", "id")


query("prj_dense_index", "SELECT CAST(n_nationkey AS BIGINT) AS idx, 'Q' || CAST(n_nationkey AS VARCHAR) AS id FROM nation")(lambda t: _kg(t).select("idx", "id"))


@query("prj_claim_field", "SELECT 'P17' AS prop, CAST(n_nationkey AS BIGINT) AS src, 'Q' || CAST(100 + n_regionkey AS VARCHAR) AS qid, 0 AS pos FROM nation")
def _(t):
    return S.claim_edges(_kg(t), ["P17", "P31"])


@query("prj_claim_getters", "SELECT CAST(n_nationkey AS BIGINT) AS idx, 1810 + n_nationkey AS year FROM nation")
def _(t):
    return S.claim_values(_kg(t), "P569", "time", first_only=True).select("idx", T.parse_year(F.get("values", F.lit(0))).cast("int").alias("year"))


@query("prj_sitelinks", "SELECT 'enwiki' AS wiki, n_name AS title, CAST(n_nationkey AS BIGINT) AS idx FROM nation")
def _(t):
    return S.sitelinks(_kg(t))


@query("src_wiki_xml", f"SELECT title, text FROM ({ARTICLES}) WHERE NOT starts_with(title, 'Help:')")
def _(t):
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = t.sql(ARTICLES).select(F.concat(F.lit("<page><title>"), esc("title"), F.lit("</title><revision><text>"), esc("text"), F.lit("</text></revision></page>")).alias("value"))
    root = lambda x: t.spark.createDataFrame([(x,)], "value string").coalesce(1)
    return S.wiki_xml(t.spark, _text(t, root("<mediawiki>").union(pages.coalesce(1)).union(root("</mediawiki>")), "wiki.xml"))


@query("src_sql_dump", "SELECT CAST(n_nationkey AS VARCHAR) AS key, 'Q' || CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def _(t):
    tuples = t.nation.select(F.concat(F.lit("INSERT ("), F.col("n_nationkey").cast("string"), F.lit(",'wikibase_item','Q999',NULL),("), F.col("n_nationkey").cast("string"), F.lit(",'other','x'),("), F.col("n_nationkey").cast("string"), F.lit(",'wikibase_item','Q"), F.col("n_regionkey").cast("string"), F.lit("',NULL);")).alias("value"))
    return S.sql_lookup(t.spark, _text(t, tuples, "props.sql"), "wikibase_item")


@query("src_redirects", "SELECT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS source, CAST(max(c_custkey) AS VARCHAR) AS target FROM customer GROUP BY 1")
def _(t):
    lines = t.customer.orderBy("c_custkey").select(F.concat_ws("\t", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("value"))
    return S.redirects(t.spark, _text(t, lines.unionByName(t.spark.createDataFrame([("x" * 300 + "\ty",), ("no tab",)], "value string")), "redirects.tsv"))


@query("src_names", f"SELECT idx, max(title) AS name FROM ({TITLES}) WHERE wiki = 'enwiki' AND idx < 500 GROUP BY idx")
def _(t):
    return S.names(t.sql(TITLES), "enwiki", 500)


query("src_name_server", "SELECT n_nationkey AS idx, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'Q' || CAST(n_nationkey AS VARCHAR) END AS name FROM nation")(
    lambda t: S.name_or_qid(t.nation.select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("qid")), t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name")))
)


@query("src_sparql", "SELECT CAST(r_regionkey AS VARCHAR) AS prop, r_name AS name FROM region")
def _(t):
    line = t.region.agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name"))).alias("m")).select(F.to_json("m").alias("value"))
    return S.property_names(t.spark, _text(t, line, "names.json"))


@query("src_sparql_pairs", "SELECT 'Q' || CAST(n_nationkey AS VARCHAR) AS key, 'Q' || CAST(100 + n_regionkey AS VARCHAR) AS value FROM nation")
def _(t):
    value = lambda c: F.struct(F.concat(F.lit("http://kg.example.org/entity/Q"), c.cast("string")).alias("value"))
    rows = t.nation.select(F.struct(value(F.col("n_nationkey")).alias("origin"), value(F.col("n_regionkey") + 100).alias("destination")).alias("b"))
    line = rows.agg(F.struct(F.struct(F.collect_list("b").alias("bindings")).alias("results")).alias("r")).select(F.to_json("r").alias("value"))
    return S.sparql_pairs(t.spark, _text(t, line, "redirects.json"), "origin", "destination")


STREAM = "SELECT user_id, event_id, event_type, row_number() OVER (ORDER BY user_id, event_id) AS n FROM events"


@query("src_tsv_dataset", f"WITH s AS ({STREAM}), e AS (SELECT user_id, min(n) AS first, count(*) AS n_tokens, count(*) FILTER (WHERE event_id % 4 = 0) AS n_labels FROM s GROUP BY 1) SELECT user_id, n_tokens, n_labels FROM e WHERE n_labels > 0")
def _(t):
    rows = t.sql(STREAM).select("n", F.concat(F.concat_ws("_", "event_type", F.col("user_id").cast("string")), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\tQ"), F.col("event_id").cast("string"))).otherwise("")).alias("value"), "user_id")
    ends = rows.groupBy("user_id").agg((F.max("n") + 0.5).alias("n"), F.lit("").alias("value")).select("n", "value", "user_id")
    # several files, each with whole users in order
    lines = rows.select(F.col("n").cast("double").alias("n"), "value", "user_id").union(ends).repartitionByRange(4, "user_id").sortWithinPartitions("n").select("value")
    found = S.token_tsv(t.spark, _text(t, lines, "tokens.tsv", None))
    labels = F.size(F.filter("tokens", lambda x: x["label"].isNotNull())).cast("long")
    return found.select(F.substring_index(F.get("tokens", F.lit(0))["token"], "_", -1).cast("long").alias("user_id"), F.size("tokens").cast("long").alias("n_tokens"), labels.alias("n_labels"))


@query("src_aida", f"""WITH s AS ({STREAM}), r AS (SELECT n, event_type, event_id, event_id % 4 = 0 AS tagged, lag(event_id % 4 = 0) OVER (ORDER BY n) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN tagged OR before IS NULL OR before THEN 1 ELSE 0 END) OVER (ORDER BY n) AS span FROM r)
SELECT CAST(1 AS BIGINT) AS doc, CAST(span AS BIGINT) AS span, string_agg(event_type, ' ' ORDER BY n) AS text, max(CASE WHEN tagged THEN CAST(event_id AS VARCHAR) END) AS key FROM g GROUP BY span""")
def _(t):
    rows = t.sql(STREAM).select("n", F.when(F.col("event_id") % 4 == 0, F.concat_ws("\t", "event_type", F.lit("B"), F.lit("m"), F.lit("x"), F.lit("t"), F.col("event_id").cast("string"))).otherwise(F.col("event_type")).alias("value"))
    lines = t.spark.createDataFrame([("-DOCSTART- (1)",)], "value string").coalesce(1).union(rows.coalesce(1).sortWithinPartitions("n").select("value"))
    return S.conll_docs(t.spark, _text(t, lines, "aida.tsv")).select("doc", "span", "text", "key")


@query("src_aida_qid", f"SELECT 'Q' || CAST(event_id AS VARCHAR) AS key, event_type AS text FROM ({STREAM}) WHERE event_id % 4 = 0")
def _(t):
    rows = t.sql(STREAM).select("n", F.when(F.col("event_id") % 4 == 0, F.concat_ws("\t", "event_type", F.lit("B"), F.lit("m"), F.concat(F.lit("Q"), F.col("event_id").cast("string")))).otherwise(F.col("event_type")).alias("value"))
    lines = t.spark.createDataFrame([("-DOCSTART- (1)",)], "value string").coalesce(1).union(rows.coalesce(1).sortWithinPartitions("n").select("value"))
    return S.conll_docs(t.spark, _text(t, lines, "aida.tsv"), 3, 4).where("key is not null").select("key", "text")


@query("src_tac", "SELECT start, start + 5 AS stop, id, w AS text FROM (SELECT doc_id AS id, 'token' AS w, strpos(text, 'token') - 1 AS start FROM documents) WHERE start >= 0")
def _(t):
    q = F.array(*[F.struct(F.lit(w).alias("text"), F.lit(e).alias("entity")) for w, e in (("token", "Q1"), ("oke", "Q2"), ("no such text", "Q3"))])
    return S.query_docs(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("doc"), q.alias("queries"))).where("text = 'token'").select("id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "text")


@query("src_wikiannot", "SELECT strpos(lower(n_name), 'nation') - 1 AS start, '7' AS entity, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    lines = t.nation.orderBy("n_nationkey").coalesce(1).select(F.explode(F.array(F.concat(F.lit("É "), F.col("n_name")), F.lit("E nation\t7"))).alias("value"))
    found = S.wikiannot(t.spark, _text(t, lines, "annot.txt"))
    return found.groupBy((F.col("start")).cast("long").alias("start"), "entity").agg(F.count(F.lit(1)).alias("n"))


@query("src_wiki_docs", f"SELECT title FROM ({ARTICLES}) ORDER BY title LIMIT 20")
def _(t):
    return t.sql(ARTICLES).select("title").orderBy("title").limit(20)


@query("src_csv_features", "SELECT n_nationkey AS k, round(ln(1 + n_regionkey), 9) AS links FROM nation")
def _(t):
    path = f"{shared_folder(t.spark)}/tessera/csv-{uuid.uuid4().hex}"
    cols = [F.lit(True).alias("OK?"), F.col("n_name").alias("Trigger"), F.lit("e").alias("Entity"), F.lit(1).alias("Contains"), F.lit(0.5).alias("String Before"), F.lit(0.5).alias("String After"), F.col("n_regionkey").alias("Existing Links"), F.lit(0.1).alias("P(Entity -> Trigger)"), F.lit(0.1).alias("P(Trigger -> Entity)"), F.col("n_nationkey").cast("double").alias("P(word -> Trigger)")]
    t.nation.select(*cols).write.option("header", True).csv(path)
    return S.density_features(t.spark, path).select(F.get("features", F.lit(7)).cast("int").alias("k"), F.round(F.get("features", F.lit(4)), 9).alias("links"))
