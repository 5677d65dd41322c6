"""Readers of dumps, corpora and dictionaries; each returns a DataFrame."""

from __future__ import annotations

import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

from . import msgpack

CLAIM = "struct<mainsnak:struct<datavalue:struct<value:string>>>"
KG = f"id string, sitelinks map<string,struct<title:string>>, claims map<string,array<{CLAIM}>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): text lines with their place.  Splits of a file are numbered in order, lines inside a
    split by a window over (file, split): no split is larger than the reader makes it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    counts = lines.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))  # a row a split
    base = counts.select("file", "_at", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_id")) - 1
    return lines.withColumn("_k", inside).join(base, ["file", "_at"]).select("file", (F.col("_base") + F.col("_k")).alias("n"), "value")


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): the objects of MessagePack files as JSON, with their place.  A stream has no marks to
    split it at, so a file is read by one task: write dumps as several files."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = msgpack.objects(data)
                n = 0
                while part := [json.dumps(x) for x in islice(found, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(n, n + len(part)), pa.int64()), pa.array(part)], names=["file", "n", "value"])
                    n += len(part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, n long, value string")


def kg_json(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge-graph dump of one JSON object a line (bz2 or plain) or of MessagePack objects (mp): (idx, id, sitelinks, claims).

    Lines that do not start with ``{`` are skipped, trailing commas too; idx is the dense place of the entity.
    """
    name = path.rstrip("/")
    if not name.endswith((".json", ".bz2", ".json.gz", ".mp")):
        raise ValueError(f"no known format: {path}")
    lines = (packed_lines if name.endswith(".mp") else numbered_lines)(spark, path).where(F.col("value").startswith("{"))
    dense = lines.groupBy("file").count()  # files in order of name
    base = dense.select("file", F.coalesce(F.sum("count").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    block = lines.withColumn("_b", F.floor(F.col("n") / (1 << 16)))
    sums = block.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sums.select("file", "_b", F.coalesce(F.sum("_c").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("file", "_b").orderBy("n")) - 1
    placed = block.withColumn("_k", nth).join(before, ["file", "_b"]).join(base, "file")
    return placed.select((F.col("_base") + F.col("_before") + F.col("_k")).alias("idx"), F.from_json(F.regexp_replace("value", r",\s*$", ""), KG).alias("e")).select("idx", "e.*")


def claim_values(entities: DataFrame, prop: str, field: str, first_only: bool = False) -> DataFrame:
    """(idx, values): ``mainsnak.datavalue.value.<field>`` of a property's claims in order, nulls skipped."""
    values = F.transform(F.col("claims")[prop], lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], f"$.{field}"))
    values = F.filter(values, lambda v: v.isNotNull())
    return entities.select("idx", (F.slice(values, 1, 1) if first_only else values).alias("values")).where(F.size("values") > 0)


def claim_edges(entities: DataFrame, props: list[str]) -> DataFrame:
    """(prop, src, qid, pos): the id links of the given properties, one scan for all."""
    own = entities.select("idx", F.explode(F.map_filter("claims", lambda k, _: k.isin(props))).alias("prop", "cs"))
    values = F.filter(F.transform("cs", lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id")), lambda v: v.isNotNull())
    return own.select("prop", F.col("idx").alias("src"), F.posexplode(values).alias("pos", "qid")).select("prop", "src", "qid", "pos")


def sitelinks(entities: DataFrame) -> DataFrame:
    """(wiki, title, idx) of the sitelinks whose key ends in ``wiki``."""
    return entities.select("idx", F.explode("sitelinks").alias("wiki", "s")).where(F.col("wiki").endswith("wiki")).select("wiki", F.col("s.title").alias("title"), "idx")


def wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a wiki dump's articles; namespaces that are no articles are left out."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:string>").load(path)
    return pages.where(~T.bad_title(F.col("title"))).select("title", F.col("revision.text").alias("text"))


def sql_lookup(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """(key, value) of ``(key,'prop','value'`` tuples in a MySQL dump; the last of a key counts."""
    lines = numbered_lines(spark, path)
    found = F.regexp_extract_all("value", F.lit(rf"\(([^(),']+),'{prop}','([^']*)'"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(rf"\(([^(),']+),'{prop}','([^']*)'"), F.lit(2))
    rows = lines.select("file", "n", F.posexplode(F.arrays_zip(found.alias("k"), values.alias("v"))).alias("at", "t"))
    return rows.groupBy(F.col("t.k").alias("key")).agg(F.max_by("t.v", F.struct("file", "n", "at")).alias("value"))


def redirects(spark: SparkSession, path: str, longest: int = 256) -> DataFrame:
    """(source, target) of a TSV: the source's first letter upper, over-long fields dropped, the last line of a source counts."""
    lines = numbered_lines(spark, path).select("file", "n", F.split("value", "\t").alias("f")).where(F.size("f") == 2)
    short = lines.where((F.octet_length(F.get("f", F.lit(0))) < longest) & (F.octet_length(F.get("f", F.lit(1))) < longest))
    return short.groupBy(T.upper_first(F.get("f", F.lit(0))).alias("source")).agg(F.max_by(F.get("f", F.lit(1)), F.struct("file", "n")).alias("target"))


def names(titles: DataFrame, wiki: str = "enwiki", num: int | None = None) -> DataFrame:
    """(idx, name) of one wiki, of ids below ``num``; the greatest title of an id counts."""
    own = titles.where(F.col("wiki") == wiki)
    own = own if num is None else own.where(F.col("idx") < num)
    return own.groupBy("idx").agg(F.max("title").alias("name"))


def name_or_qid(ids: DataFrame, found: DataFrame) -> DataFrame:
    """``ids(idx, qid)`` with ``name``: the title, else the qid."""
    return ids.join(found, "idx", "left").select("idx", F.coalesce("name", "qid").alias("name"))


def property_names(spark: SparkSession, path: str) -> DataFrame:
    """(prop, name) of a cached JSON object of property names."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return row.select(F.explode("m").alias("prop", "name"))


def sparql_pairs(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of a cached SPARQL response in JSON: two fields of its bindings (lists of properties by kind,
    of redirects); of entity addresses the id alone; the last of a key counts."""
    form = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", form)["results"]["bindings"]).alias("n", "b"))
    plain = lambda c: F.regexp_replace(F.col("b")[c]["value"], r"^https?://[^/]+/entity/", "")
    return rows.select("n", plain(key).alias("key"), plain(value).alias("value")).groupBy("key").agg(F.max_by("value", "n").alias("value"))


def islands(lines: DataFrame, starts, by: str = "file") -> DataFrame:
    """Lines with ``group``: how many lines that ``starts`` marks lie at or before each (block sums first, so
    that no task orders a whole file)."""
    marked = lines.withColumns({"_s": starts.cast("int"), "_b": F.floor(F.col("n") / (1 << 16))})
    sums = marked.groupBy(by, "_b").agg(F.sum("_s").alias("_c"))
    before = sums.select(by, "_b", F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_s").over(Window.partitionBy(by, "_b").orderBy("n"))
    return marked.withColumn("_in", inside).join(before, [by, "_b"]).withColumn("group", F.col("_before") + F.col("_in")).select(*lines.columns, "group")


def resolved(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """``tokens(..., qid)`` with ``idx`` of the entity, null where ``entities(idx, qid)`` has none."""
    return tokens.join(entities.select("idx", "qid"), "qid", "left")


def token_tsv(spark: SparkSession, path: str, comment: str = "#//#") -> DataFrame:
    """Examples of a token TSV (file, example, tokens array of (token, label)): blank and comment lines
    end an example; examples without a label are dropped."""
    lines = numbered_lines(spark, path)
    ends = (F.trim("value") == "") | F.col("value").startswith(comment)
    rows = islands(lines, ends).where(~ends).withColumn("f", F.split("value", "\t"))
    token = F.struct("n", F.get("f", F.lit(0)).alias("token"), F.nullif(F.get("f", F.lit(1)), F.lit("")).alias("label"))
    grouped = rows.groupBy("file", F.col("group").alias("example")).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return grouped.where(F.exists("tokens", lambda t: t["label"].isNotNull())).select("file", "example", F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), t["label"].alias("label"))).alias("tokens"))


def conll_docs(spark: SparkSession, path: str, mention_column: int = 5, least_columns: int = 6) -> DataFrame:
    """Spans of a CoNLL-style TSV: (file, doc, span, text, key): ``-DOCSTART-`` starts a document; a line of
    enough columns belongs to a mention, which starts at ``B``; ``key`` is the mention column (page id or qid)."""
    lines = numbered_lines(spark, path)
    docs = islands(lines, F.col("value").startswith("-DOCSTART-")).withColumnRenamed("group", "doc").where(~F.col("value").startswith("-DOCSTART-") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    rows = docs.select("file", "doc", "n", F.get(f, F.lit(0)).alias("token"), F.when(F.size(f) >= least_columns, F.get(f, F.lit(1))).alias("tag"), F.when(F.size(f) >= least_columns, F.get(f, F.lit(mention_column))).alias("key"))
    order = Window.partitionBy("file", "doc").orderBy("n")
    starts = F.col("tag").eqNullSafe("B") | (F.col("tag").isNull() != F.lag("tag").over(order).isNull()) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("_s", starts).withColumn("span", F.sum(F.col("_s").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), " ")
    return rows.groupBy("file", "doc", "span").agg(text.alias("text"), F.min_by("key", "n").alias("key"))


def query_docs(docs: DataFrame) -> DataFrame:
    """``docs(id, doc, queries array<struct<text,entity>>)`` to (id, start, stop, text, entity): each query at
    its first place in the document; in order of place, those that overlap an earlier one are dropped."""
    placed = F.filter(F.transform("queries", lambda q: F.struct((F.position(q["text"], F.col("doc")) - 1).alias("start"), (F.position(q["text"], F.col("doc")) - 1 + F.length(q["text"])).alias("stop"), q["text"].alias("text"), q["entity"].alias("entity"))), lambda q: q["start"] >= 0)
    rows = docs.select("id", F.array_sort(placed).alias("p"))
    kept = F.aggregate("p", F.slice(F.col("p"), 1, 0), lambda a, q: F.when((F.size(a) == 0) | (q["start"] >= F.coalesce(F.try_element_at(a, F.lit(-1))["stop"], F.lit(0))), F.concat(a, F.array(q))).otherwise(a))
    return rows.select("id", F.inline(kept))


def tac_json(spark: SparkSession, path: str) -> DataFrame:
    """Links of a file with a JSON array of ``{doc, queries: [{text, entity}]}``, as ``query_docs``."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<doc:string,queries:array<struct<text:string,entity:string>>>>")).alias("id", "d"))
    return query_docs(rows.select("id", "d.doc", "d.queries"))


def wikiannot(spark: SparkSession, path: str) -> DataFrame:
    """Links of alternating text and tag lines (tags: anchor TAB page id ...), as ``query_docs``; both
    sides are compared as lower-case plain letters, spans are places in the text; the id is (file, line)."""
    lines = numbered_lines(spark, path)
    pairs = lines.groupBy(F.struct("file", F.floor(F.col("n") / 2).alias("line")).alias("id")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("value"))).alias("doc"), F.max(F.when(F.col("n") % 2 == 1, F.col("value"))).alias("tags"))
    f = F.split("tags", "\t")
    tags = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(f) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.lower(T.plain_letters(F.get(f, 2 * i))).alias("text"), F.get(f, 2 * i + 1).alias("entity")))
    return query_docs(pairs.select("id", F.lower(T.plain_letters(F.col("doc"))).alias("doc"), F.filter(tags, lambda q: q["entity"].isNotNull()).alias("queries")))


def density_features(spark: SparkSession, path: str) -> DataFrame:
    """(ok, features array<double>) of the densification CSV: lower-case flag first, the links' count as log1p."""
    schema = "`OK?` boolean, Trigger string, Entity string, Contains int, `String Before` double, `String After` double, `Existing Links` int, `P(Entity -> Trigger)` double, `P(Trigger -> Entity)` double, `P(word -> Trigger)` double"
    rows = spark.read.option("header", True).schema(schema).csv(path)
    lower = (F.col("Trigger") == F.lower("Trigger")).cast("double")
    parts = [lower, F.col("Contains").cast("double"), F.col("`String Before`"), F.col("`String After`"), F.log1p("`Existing Links`"), *[F.col(f"`{c}`") for c in ("P(Entity -> Trigger)", "P(Trigger -> Entity)", "P(word -> Trigger)")]]
    return rows.select(F.col("`OK?`").alias("ok"), F.array(*parts).alias("features"))


def load_config(path: str, defaults: dict | None = None) -> dict:
    """A JSON configuration over defaults; values of keys ending in ``path`` are relative to the file."""
    from pathlib import Path

    found = dict(defaults or {}) | json.loads(Path(path).read_text())
    fix = lambda k, v: str(Path(path).parent / v) if isinstance(v, str) and k.endswith("path") and v and not v.startswith("/") else {a: fix(a, b) for a, b in v.items()} if isinstance(v, dict) else [fix(k, x) for x in v] if isinstance(v, list) else v
    return {k: fix(k, v) for k, v in found.items()}
