"""Resolving titles and links to entities: ``titles(wiki, title, idx)``, ``redirects(source, target)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def resolve(dests: DataFrame, titles: DataFrame, redirects: DataFrame, wiki: str) -> DataFrame:
    """``dests(dest, ...)`` with ``idx``: the title as given, else cleaned up, else the redirect of the
    cleaned title, cleaned up; null if none is known.  One redirect is followed."""
    known = titles.where(F.col("wiki") == wiki).select("title", "idx")
    tier = lambda n: known.select(F.col("title").alias(f"_t{n}"), F.col("idx").alias(f"_i{n}"))
    hops = redirects.select(T.upper_first(F.col("source")).alias("_src"), T.clean_title(F.col("target")).alias("_hop")).groupBy("_src").agg(F.max("_hop").alias("_hop"))
    d = dests.withColumn("_clean", T.clean_title(F.col("dest")))
    d = d.join(tier(1), F.col("dest") == F.col("_t1"), "left").join(tier(2), F.col("_clean") == F.col("_t2"), "left")
    d = d.join(hops, F.col("_clean") == F.col("_src"), "left").join(tier(3), F.col("_hop") == F.col("_t3"), "left")
    return d.select(*[F.col(c) for c in dests.columns], F.coalesce("_i1", "_i2", "_i3").alias("idx"))


def category_links(rows: DataFrame, titles: DataFrame, wiki: str) -> tuple[DataFrame, DataFrame]:
    """``rows(article, category)`` to (src, dst) edges, and the rows that have no known article or category.

    A category is looked up as given, then with its first letter upper (after the prefix's colon).
    """
    known = titles.where(F.col("wiki") == wiki)
    a = known.select(F.col("title").alias("article"), F.col("idx").alias("src"))
    c1, c2 = known.select(F.col("title").alias("category"), F.col("idx").alias("_d1")), known.select(F.col("title").alias("_upper"), F.col("idx").alias("_d2"))
    r = rows.where("category is not null and category <> ''").withColumn("_upper", T.upper_first(F.col("category")))
    r = r.join(a, "article", "left").join(c1, "category", "left").join(c2, "_upper", "left").withColumn("dst", F.coalesce("_d1", "_d2"))
    good = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return r.where(good).select("src", "dst"), r.where(~good).select("article", "category")


def resolve_anchors(rows: DataFrame, titles: DataFrame, redirects: DataFrame, wiki: str, longest: int = 256) -> DataFrame:
    """``rows(context, anchor, target)`` to (context, anchor, idx): over-long fields and unresolved targets go."""
    short = rows.where((F.octet_length("context") < longest) & (F.octet_length("anchor") < longest) & (F.octet_length("target") < longest))
    found = resolve(short.withColumnRenamed("target", "dest"), titles, redirects, wiki)
    return found.where("idx is not null").select("context", "anchor", "idx")


def means(rows: DataFrame, known_anchors: DataFrame, titles: DataFrame, redirects: DataFrame, wiki: str) -> DataFrame:
    """A means dictionary ``rows(mention, dest)`` (mention quoted, with \\uXXXX escapes) to (anchor, idx) of acceptable known anchors."""
    raw = F.regexp_replace("mention", '^"|"$', "")
    plain = F.from_json(F.concat(F.lit('{"m":"'), F.regexp_replace(raw, r'(?<!\\)"', r'\\"'), F.lit('"}')), "m string")["m"]
    cleaned = rows.select(T.clean_anchor(F.coalesce(plain, raw)).alias("anchor"), "dest").where(T.acceptable(F.col("anchor")))
    return resolve(cleaned.join(known_anchors.select("anchor"), "anchor", "left_semi"), titles, redirects, wiki).where("idx is not null").select("anchor", "idx").distinct()


def acceptable_anchors(candidates: DataFrame, known_anchors: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """Those of ``candidates(anchor)`` that are well formed, known, and not blacklisted."""
    out = candidates.where(T.acceptable(F.col("anchor"))).join(known_anchors.select("anchor"), "anchor", "left_semi")
    return out if blacklist is None else out.join(blacklist.select("anchor"), "anchor", "left_anti")


def has_prefix(prefixes: DataFrame, keys: DataFrame) -> DataFrame:
    """``prefixes(prefix)`` with ``found``: whether a key of words starts with the prefix at a word's end."""
    heads = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", " "))), lambda n: F.array_join(F.slice(F.split("key", " "), 1, n), " "))).alias("prefix")).distinct()
    return prefixes.join(heads.withColumn("_f", F.lit(True)), "prefix", "left").select("prefix", F.coalesce("_f", F.lit(False)).alias("found"))


def transition(stale: DataFrame, moves: DataFrame, options: DataFrame) -> DataFrame:
    """``stale(anchor_id, old)`` to ``idx``: the anchor's move if it is still an option, else the old id if that is, else null."""
    moved = stale.join(moves.select("anchor_id", F.col("old"), F.col("new")), ["anchor_id", "old"], "left").withColumn("_c", F.coalesce("new", "old"))
    open_ = options.select("anchor_id", F.col("entity").alias("_c")).withColumn("_ok", F.lit(True))
    return moved.join(open_, ["anchor_id", "_c"], "left").select("anchor_id", "old", F.when(F.col("_ok"), F.col("_c")).alias("idx"))
