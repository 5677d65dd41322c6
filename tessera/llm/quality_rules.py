"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Every rule compares one text statistic with a cutoff.  The rule sets ``LEVELS`` form a
fixed sequence from lenient to strict: a level names a cutoff for every rule, and turns
away what any of them turns away.  Labelled documents certify levels for each stratum
(language): going down the sequence, a level is certified while the exact binomial
(Clopper-Pearson) test rejects "it turns away more than ``alpha`` of the good documents"
at level ``delta / n_strata``: fixed-sequence testing inside a stratum, Bonferroni across
strata.  Among certified levels the one with the best gain (bad turned away minus
``cost`` times good turned away) is used; a stratum without a certified, gainful level
turns nothing away.  So with probability ``1 - delta`` no stratum loses more than
``alpha`` of its good documents to the rules.  (As all rules share one sequence, alpha is
not divided among them: with four strata some 110 good labels without an error certify a level.)

Defined results: a null text has no words (and fails the base rule); a null language is
the stratum ``unknown``; a stratum without labels gets no level; labels other than
0 and 1 are ignored; of several labels of one document the lowest counts; repeated
rows are judged each on their own; empty tables give empty results; further columns
of the input are neither read nor overwritten (``keep_good`` hands them through).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, let, materialize, table, words

#: Cutoffs of each rule at each level, lenient to strict.  A document is turned away above any cutoff of its stratum's level.
LEVELS = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "word_length": (30.0, 28.0, 26.0, 24.0, 22.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0),
    "dup_lines": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4),
    "repeats": (0.5, 0.49, 0.48, 0.47, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, DELTA, COST = 0.04, 0.05, 10
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(windows: Column) -> Column:
    """Words inside 3-word windows whose hash occurs twice or more: sort (hash, place), keep
    the places of equal neighbours, and add up the union of [place, place + 3)."""
    def places(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(a["end"], p)).cast("long")).alias("n"))
    return F.aggregate(let(pairs, places), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def score(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, the five metrics, n_lines (lines with a word), base_failed.

    ``keep``: a further column (such as a struct of the whole row) to carry along as ``_doc``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<bigint>")
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    # everything that is used more than once is bound by let(): wherever the optimizer moves these columns, nothing is computed once per element
    word_count = lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) < 3, none).otherwise(hashes(w)).alias("k"))
    repeats = lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(_covered(k))
    by_word = let(let(words(F.col("text")), word_count), lambda s: F.struct(s["n"].cast("long").alias("n_words"), repeats(s["k"]).alias("n_repeat_words")))
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    by_line = let(with_word, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    carried = [keep.alias("_doc")] if keep is not None else []
    third = docs.select(
        *carried, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("stratum"),
        by_word.alias("_by_word"), by_line.alias("_by_line"),
        F.char_length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    third = third.select(*(["_doc"] if carried else []), "doc_id", "stratum", "word_chars", "n_symbols", "_by_word.*", "_by_line.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return third.withColumn("base_failed", failed)


def _statistic(rule: str) -> Column:
    over = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {"symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}[rule]


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding, summed in log space; 0 where k > p * n (no test passes there)."""
    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    zero = F.struct(first.alias("term"), first.alias("total"))
    folded = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, step, lambda a: a["total"])
    return F.when(k > n * p, F.lit(0.0)).when(k < 1, first).otherwise(folded)


def marked(labels: DataFrame) -> DataFrame:
    """(_id, _y): one row for each labelled document."""
    return labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_y").isin(0, 1)).groupBy("_id").agg(F.min("_y").alias("_y"))


def first_level(metrics: DataFrame) -> Column:
    """The first level that turns a document away; the number of levels if none does."""
    return F.least(*[sum((_statistic(r) <= c).cast("int") for c in cutoffs) for r, cutoffs in LEVELS.items()])


def calibrate(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """One row per stratum with labels: stratum and level (null: nothing is turned away).

    Counts of (stratum, first level that turns a labelled document away) are all that is shuffled.
    """
    seen = metrics.where(~F.col("base_failed")).join(marked(labels), F.col("doc_id") == F.col("_id")).select("stratum", "_y", first_level(metrics).alias("j"))
    bins = seen.groupBy("stratum", "j").agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad"))
    sums = bins.groupBy("stratum").agg(F.collect_list(F.struct("j", "good", "bad")).alias("bins"), F.sum("good").alias("n"))
    # a row per stratum; their number enters Bonferroni's correction
    sums = sums.withColumn("least", F.log(F.lit(delta) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))))
    upto = lambda j, what: F.aggregate(F.filter("bins", lambda b: b["j"] <= j), F.lit(0).cast("long"), lambda a, b: a + b[what])
    levels = F.sequence(F.lit(0), F.lit(len(LEVELS["symbols"]) - 1))
    tried = sums.withColumn("steps", F.transform(levels, lambda j: F.struct(j.alias("j"), upto(j, "good").alias("k"), upto(j, "bad").alias("bad"))))
    # k only grows along the sequence, so the levels that pass are its beginning
    passed = F.filter("steps", lambda s: (log_binomial_tail(F.col("n"), s["k"], alpha) <= F.col("least")) & (s["bad"] > cost * s["k"]))
    best = F.array_max(F.transform(passed, lambda s: F.struct((s["bad"] - cost * s["k"]).alias("gain"), (-s["j"]).alias("lenient"))))["lenient"]
    return tried.select("stratum", (-best).alias("level"))


def judge(metrics: DataFrame, levels: DataFrame) -> DataFrame:
    """``metrics`` with ``kept``: false for base failures and for a statistic above a cutoff of its stratum's level."""
    above = F.lit(False)
    for rule, cutoffs in LEVELS.items():
        above = above | F.coalesce(_statistic(rule) > F.get(F.array(*map(F.lit, cutoffs)), F.col("_level")), F.lit(False))
    joined = metrics.join(levels.select(F.col("stratum"), F.col("level").alias("_level")), "stratum", "left")
    # one expression, not a conjunction: a filter on it is not split and moved to where the statistics would be computed anew
    return joined.withColumn("kept", ~F.greatest(F.col("base_failed"), above))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.  Rows are written once beside
    their statistics: texts are scored a single time, and neither labels nor verdicts make them move."""
    scored = materialize(score(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "quality-metrics")
    levels = materialize(calibrate(scored, labels, **settings), "quality-levels")
    return judge(scored, levels).where("kept").select("_doc.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    metrics = materialize(score(table(spark, sf_dir, "documents")), "quality-metrics")
    levels = materialize(calibrate(metrics, table(spark, sf_dir, "labels")), "quality-levels")
    return judge(metrics, levels).select("doc_id", *METRICS, "base_failed", "kept")
