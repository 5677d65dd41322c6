"""URL filters by association rules: FP-growth mines token combinations of labelled URLs.

A URL is a set of tokens: its host's labels (with their place from the end) and the words
inside them, its path parts (with their depth), its file's words and ending, and its
query's keys.  Labelled URLs become transactions of their tokens and, where blocked, a mark
``verdict=block``.

Rules are mined on one hash fold of the labels: frequent combinations that hold the mark
and whose confidence reaches ``CONFIDENCE``.  They are tested on the other fold: a rule
stays if its confidence there reaches ``CONFIDENCE`` too, and ``LIFT`` times the share of
blocked URLs.  The labels are the verdicts of given host and path rules, so a combination
may do no more than tell one of those again, in words that fit other pages by chance: a
rule stays only if the blocked URLs it fits come from ``SOURCES`` given rules or more.  A
rule is pruned where a part of its tokens is a rule already.

Rules are matched by an inverted index: each stands under its rarest token, a URL looks up
its tokens, and what it finds is checked whole.  A URL that any rule fits is blocked.

Defined results: a null url, or one without ``://``, has empty host and path, no rule,
and is allowed; repeated rows each get their row; without labelled URLs nothing is
mined and all others are allowed; empty tables give empty results; further columns are
not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, table

#: (host, path, verdict): fits the host and its subdomains where the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, CONFIDENCE, LIFT, SOURCES = 0.01, 0.95, 1.2, 2
#: A rule needs at least this many labelled URLs of the mining fold, however few there are.
LEAST = 5
BLOCK = "verdict=block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _all(prefix: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels from the end (h1 is the last), words inside labels, path parts by depth, words and ending of the file, query keys."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit("="), x))
    inside = F.flatten(F.transform(labels, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    steps = F.split(F.regexp_extract(path, r"^/(.*)/", 1), "/")
    dirs = F.filter(F.transform(steps, lambda x, i: F.when(x != "", F.concat(F.lit("dir"), (i + 1).cast("string"), F.lit("="), x))), lambda x: x.isNotNull())
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    ending = F.regexp_extract(file, r"\.([A-Za-z0-9]{1,5})$", 1)
    names = F.regexp_extract_all(F.lower(F.regexp_replace(file, r"\.[A-Za-z0-9]{1,5}$", "")), F.lit("[a-z]{2,}"), F.lit(0))
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_distinct(F.concat(placed, _all("word=", inside), dirs, _all("file=", names), _all("end=", F.array(ending)), _all("key=", keys)))


def fold(url: Column) -> Column:
    """0 (to mine) or 1 (to test), by a hash of the URL."""
    return (F.substring(F.md5(url), 1, 1) >= "8").cast("int")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, lift: float = LIFT, sources: int = SOURCES) -> DataFrame:
    """``labelled(tokens, rule, blocked, fold)`` to rules (anchor, items, confidence, n), tested and pruned: the
    confidence on the test fold and the number of URLs there; anchor is the rarest item."""
    spark = labelled.sparkSession
    seen = materialize(labelled.where(F.size("tokens") > 0).select(F.array_sort("tokens").alias("_set"), "rule", "blocked", "fold"), "labelled-urls")
    baskets = seen.where("fold = 0").select(F.when(F.col("blocked"), F.array_append("_set", F.lit(BLOCK))).otherwise(F.col("_set")).alias("items"))
    schema = "anchor string, items array<string>, confidence double, n long"
    n = baskets.count()
    if n < least:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=max(support, (least - 0.5) / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("items"))
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("_t"), "freq")
    rarest = found.select("items", F.explode("items").alias("_t")).join(counts, "_t").groupBy("items").agg(F.min_by("_t", F.struct("freq", "_t")).alias("anchor"))
    found = materialize(rarest, "mined-rules")

    # equal sets of tokens are tested once, with their number
    test, hit = F.col("fold") == 1, F.col("blocked")
    sets = seen.groupBy("_set", "rule", "blocked", "fold").agg(F.count(F.lit(1)).alias("c"))
    looked = sets.select("*", F.explode("_set").alias("anchor")).join(found, "anchor").where(F.size(F.array_intersect("items", "_set")) == F.size("items"))
    tested = looked.groupBy("anchor", "items").agg(F.sum(F.when(test, F.col("c"))).alias("n"), F.sum(F.when(test & hit, F.col("c"))).alias("b"), F.count_distinct(F.when(hit, F.col("rule"))).alias("sources"))
    share = seen.where(test).agg(F.avg(hit.cast("int"))).first()[0] or 0.0
    good = tested.withColumn("confidence", F.col("b") / F.col("n")).where((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * share) & (F.col("sources") >= sources))
    good = materialize(good.select("anchor", "items", "confidence", "n"), "tested-rules")
    # a rule is needless where a shorter one's tokens are among its own; parts are found by the rules' own tokens
    shorter = good.select(F.col("items").alias("_part"), F.get("items", F.lit(0)).alias("_t"))
    inner = good.select("items", F.explode("items").alias("_t")).join(shorter, "_t")
    needless = inner.where((F.size("_part") < F.size("items")) & (F.size(F.array_intersect("_part", "items")) == F.size("_part"))).select("items").distinct()
    return materialize(good.join(needless, "items", "left_anti").select("anchor", "items", "confidence", "n"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(..., tokens)`` with ``blocked``: whether any rule's items are all among the tokens.

    FP-growth bounds the rules by the support, not by the corpus; the size check of the
    optimizer decides whether they are broadcast.  URLs with the same tokens are looked up once.
    """
    distinct = urls.select(F.array_sort("tokens").alias("_set")).distinct()
    looked = distinct.select("_set", F.explode("_set").alias("anchor")).join(rules, "anchor")
    hits = looked.where(F.size(F.array_intersect("items", "_set")) == F.size("items")).select("_set").distinct()
    hits = materialize(hits, "blocked-sets").withColumn("_hit", F.lit(True))
    return urls.withColumn("_set", F.array_sort("tokens")).join(hits, "_set", "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_set", "_hit")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict."""
    host, path = parts(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("_url"))
    split = split.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("_url")))
    labelled = split.where("_fit is not null").select("tokens", "_fit.rule", (F.col("_fit.verdict") == "block").alias("blocked"), fold(F.col("_url")).alias("fold"))
    judged = matched(split, mine(labelled, support, confidence))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"))


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
