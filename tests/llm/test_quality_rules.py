"""Quality rules: metrics against plain Python, exact bounds, guarantees, edge cases."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_metrics_on_a_table_and_edge_cases(spark, sf_small):
    made = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\nl1 \nl1", "🎉 é $$ | <", "w " * 50, " ".join(map(str, range(70_000))), "a b c d " * 9000]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(None if i == 3 else 10_000 + i, t, None) for i, t in enumerate(made)], "doc_id long, text string, lang string")).withColumn("n_words", F.lit("clash"))
    got = Q.score(docs).select("doc_id", *Q.METRICS, "base_failed").collect()
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r
    assert len(got) == docs.count()


@pytest.mark.parametrize("n, k, p", [(50, 0, 0.05), (300, 2, 0.02), (20_000, 150, 0.01), (200_000, 1800, 0.01), (7, 0, 0.5)])
def test_binomial_tail_is_exact(spark, n, k, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    want = top + math.log(sum(math.exp(x - top) for x in logs))
    got = spark.createDataFrame([(n, k)], "n long, k long").select(Q.log_binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-6)


def _docs(spark, n_good, n_bad, bad_share_of_good=0.0):
    rows = spark.range(n_good + n_bad).withColumn("good", F.col("id") < n_good)
    junk = (~F.col("good")) | (F.col("id") < int(n_good * bad_share_of_good))
    word = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("id") * 61 + i).cast("string"), F.when(junk, "$$$").otherwise("")))
    docs = rows.select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    return docs, rows.select(F.col("id").alias("doc_id"), F.col("good").cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_cutoffs_are_certified_or_absent(spark):
    docs, labels = _docs(spark, 1500, 300)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1500
    docs, labels = _docs(spark, 60, 100)  # too few good ones: 0.96 ** 60 > 0.05
    assert Q.keep_good(docs, labels).count() == 160
    docs, labels = _docs(spark, 1500, 300, 0.05)  # the rules would turn away 5 % of the good ones
    assert Q.keep_good(docs, labels).count() == 1800


def test_no_labels_nulls_and_empty(spark):
    docs, labels = _docs(spark, 60, 0)
    odd = labels.limit(3).select("doc_id", F.lit(None).cast("int").alias("quality"), "toxic").union(labels.limit(1).select(F.lit(None).cast("long"), F.lit(7), "toxic"))
    assert Q.keep_good(docs, labels.where("false")).count() == 60
    assert Q.keep_good(docs, odd).count() == 60
    assert Q.keep_good(docs.where("false"), labels).count() == 0


def test_guarantee_by_resampling(spark):
    """Strata drawn again and again, whose true share of good documents turned away grows along the levels and passes
    alpha at the fifth: a level beyond the fourth is used in at most the share delta of them."""
    rng, n, times, delta = np.random.default_rng(4), 400, 300, 0.05
    true = np.array([0.001, 0.005, 0.01, 0.02, Q.ALPHA + 0.001, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3])
    cutoffs = Q.LEVELS["symbols"]
    at = [int(1000 * c) + 1 for c in cutoffs]  # symbols of a text of 1000 characters that the level just turns away
    rows, doc = [], 0
    for s in range(times):
        for j, k in enumerate(rng.multinomial(n, np.diff([0, *true, 1]))):
            for _ in range(k):
                rows.append((doc, f"s{s}", at[j] if j < len(at) else 0, 1))
                doc += 1
        for j in range(len(at)):  # bad documents by the hundred, so that strict levels pay
            rows += [(doc + i, f"s{s}", at[j], 0) for i in range(100)]
            doc += 100
    seen = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "stratum", "n_symbols", "quality"]))
    metrics = seen.select("doc_id", "stratum", F.lit(1000).alias("word_chars"), "n_symbols", F.lit(200).alias("n_words"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"), F.lit(1).alias("n_lines"), F.lit(False).alias("base_failed"))
    got = [r.level for r in Q.calibrate(metrics, seen.select("doc_id", "quality"), delta=delta * times, cost=0).collect()]
    assert len(got) == times and sum(x is not None for x in got) > 0.9 * times
    assert sum(x is not None and true[x] > Q.ALPHA for x in got) <= delta * times + 2 * (delta * times) ** 0.5


def test_repeated_rows_and_labels(spark):
    docs, labels = _docs(spark, 200, 30)
    kept = Q.keep_good(docs.union(docs), labels.union(labels.withColumn("quality", F.lit(1))))
    assert kept.count() == 400  # each bad document counts as bad, each row for itself


def test_bad_documents_of_a_table_are_caught(spark):
    """Cutoffs are certified at sf0.01 for English, the one language with enough labels there, and catch most labelled bad documents."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    metrics, labels = Q.score(read("documents")).cache(), read("labels")
    levels = Q.calibrate(metrics, labels)
    assert {r.stratum for r in levels.where("level is not null").collect()} == {"en"}
    judged = Q.judge(metrics, levels).join(labels, "doc_id").where("not base_failed and stratum = 'en'").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in judged}
    assert kept[0] < 0.1 and kept[1] > 0.99
