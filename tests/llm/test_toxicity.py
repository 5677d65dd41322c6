"""Toxicity: held-out accuracy, whole texts in steps, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

BAD = ["grumbleworm", "snarkfish", "blathering", "vexspawn"]


def _data(spark, n=1500):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("ran", "tol", "nis", "pek", "dum", "vox")]
    docs, labels = [], []
    for i in range(n):
        words, toxic = list(rng.choice(vocabulary, rng.integers(5, 80))), int(i % 4 == 0)
        if toxic:
            words.insert(int(rng.integers(0, len(words))), BAD[i // 4 % len(BAD)].upper() + "!!")
        docs.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_independence(spark):
    docs, labels = _data(spark)
    model = T.train(docs, labels)
    rows = T.score(docs, *model).join(labels, "doc_id").withColumn("held", T.fold(F.col("doc_id")) == 0).select("held", T.F.col("score"), labels["toxic"].alias("y")).where("held").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.y) for r in rows]) > 0.95
    # flipping held-out labels, languages and ids changes no score
    flipped = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.score(docs.withColumn("lang", F.lit("xx")), *T.train(docs, flipped))
    a = {r.doc_id: r.score for r in T.score(docs, *model).collect()}
    assert all(abs(a[r.doc_id] - r.score) < 1e-6 for r in again.collect())


def test_pooling_in_steps_is_that_of_the_whole(monkeypatch):
    net, rng = T.Network.fresh(), np.random.default_rng(2)
    lists = [rng.integers(T.FIRST, T.FIRST * 5000, n) for n in (0, 1, 2, 3, 500, 0, 77)]
    values, offsets = np.concatenate(lists).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in lists])]
    whole = T.pool(net, values, offsets)
    monkeypatch.setattr(T, "STEP", 13)
    assert np.allclose(T.pool(net, values, offsets), whole)
    one = T.pool(net, lists[4].astype(np.int64), np.array([0, 500]))
    assert np.allclose(one[0], whole[4])


def test_edge_cases(spark):
    docs, labels = _data(spark, 200)
    odd = spark.createDataFrame([(900, None, None), (901, "", "fr"), (902, "!!! ...", "en"), (None, "snarkfish", "en"), (903, "dog " * 70_000 + "vexspawn", "en"), (1, "x", "en"), (1, "x", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("codes", F.lit(1))
    model = T.train(docs, labels.union(spark.createDataFrame([(900, 1, None), (None, 0, 1), (5, 0, 9)], labels.schema)))
    rows = T.score(odd, *model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert T.score(docs.where("false"), *model).count() == 0
    assert T.train(docs.where("false"), labels) == (None, {}) == T.train(docs, labels.where("false"))
    none = T.score(odd, *T.train(docs, labels.where("toxic = 0"))).collect()
    assert all(r.score == 0.5 and not r.toxic for r in none)


def test_thresholds_come_from_all_calibration_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_ROWS", 200)
    docs, labels = _data(spark)
    # a language that only texts over MOST_WORDS are written in
    long = spark.range(2000, 2040).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("bran "), 6000)).otherwise(F.concat(F.repeat(F.lit("bran "), 6000), F.lit("snarkfish"))).alias("text"), F.lit("zz").alias("lang"))
    docs = docs.unionByName(long)
    labels = labels.unionByName(long.select("doc_id", F.lit(1).cast("long").alias("quality"), (F.col("doc_id") % 2).alias("toxic")))
    net, thresholds = T.train(docs, labels)
    rows = T.score(docs, net, {}).join(labels, "doc_id").where(T.fold(F.col("doc_id")) == 1).select("lang", "score", labels["toxic"].alias("y")).collect()
    assert len(rows) > 250
    want = {}
    for lang in {r.lang for r in rows}:
        own = [(r.score, r.y) for r in rows if r.lang == lang]
        f1 = lambda c: 2 * sum(y for s, y in own if s >= c) / max(1, sum(s >= c for s, _ in own) + sum(y for _, y in own))  # noqa: E731, B023
        want[lang] = max((k / 20 for k in range(1, 20)), key=lambda c: (f1(c), -abs(c - 0.5)))
    assert thresholds == want and set(want) == {"de", "en", "zz"}


def plain_score(net, codes):
    """The score of one text by loops over its places and filters."""
    best = []
    for width, (k, w) in enumerate(zip(T.WIDTHS, net.filters)):
        for f in range(T.FILTERS):
            seen = []
            for i in range(len(codes)):
                z = float(net.bias[width * T.FILTERS + f])
                for j in range(k):
                    if i + j < len(codes):
                        word, *stems = T.buckets(codes[i + j : i + j + 1])
                        x = net.word[word[0]] + sum(net.stem[s[0]] for s in stems)
                        z += float(x @ w[j * T.DIMENSIONS : (j + 1) * T.DIMENSIONS, f])
                seen.append(z)
            best.append(max(0.0, max(seen, default=0.0)))
    return 1 / (1 + np.exp(-(np.dot(best, net.out) + net.out_bias)))


def _small():
    rng = np.random.default_rng(8)
    net = T.Network.fresh()
    net.bias += rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    return net, [rng.integers(T.FIRST, T.FIRST * 50, n).astype(np.int64) for n in (1, 2, 5, 9)]


def test_scores_are_those_of_plain_loops():
    net, docs = _small()
    offsets = np.r_[0, np.cumsum([len(d) for d in docs])]
    got = net.score(T.pool(net, np.concatenate(docs), offsets))
    assert np.allclose(got, [plain_score(net, d) for d in docs], atol=1e-5)


def test_one_step_of_training_follows_the_numerical_gradient():
    """With one batch, a parameter moves by RATE * g / sqrt(1e-3 + g * g), which gives g."""
    _, docs = _small()
    y = np.array([1.0, 0.0, 1.0, 0.0], np.float32)
    start, after = T.Network.fresh(T.SEED), T.fit(docs, y, epochs=1)

    def loss(net):
        p = np.array([plain_score(net, d) for d in docs])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("word", "stem", "out", "bias", "out_bias"):
        setattr(start, name, np.float64(getattr(start, name)))
    start.filters = [w.astype(np.float64) for w in start.filters]
    used = T.buckets(docs[2])
    for get, at in [
        (lambda n: n.out, (3,)), (lambda n: n.out, (40,)), (lambda n: n.bias, (20,)), (lambda n: n.filters[0], (2, 5)), (lambda n: n.filters[2], (33, 1)),
        (lambda n: n.word, (int(used[0][0]), 4)), (lambda n: n.stem, (int(used[1][1]), 0)), (lambda n: n.stem, (int(used[2][2]), 7)),
    ]:
        table, eps = get(start), 1e-5
        table[at] += eps
        high = loss(start)
        table[at] -= 2 * eps
        low = loss(start)
        table[at] += eps
        moved = float(table[at] - get(after)[at])
        g = moved * np.sqrt(1e-3) / np.sqrt(max(T.RATE**2 - moved**2, 1e-12))
        assert abs(g - (high - low) / (2 * eps)) < 2e-4 + 0.02 * abs(g)


def test_no_words_are_made_in_a_filter_on_the_documents(spark, sf_small):
    """The bounded sample and the calibration rows are joined before their texts are read as words."""
    docs, labels = (spark.read.parquet(f"{sf_small}/{n}.parquet") for n in ("documents", "labels"))
    plans, own = [], T.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return own(df, name)

    T.materialize = seen
    try:
        T.labelled(docs, labels, [2, 3, 4], 10)
    finally:
        T.materialize = own
    assert len(plans) == 1 and "transform" not in plans[0] and "Join" in plans[0]


def test_classify_is_train_and_score(spark):
    docs, labels = _data(spark, 300)
    key = lambda df: sorted((r.doc_id, round(r.score, 9), r.toxic) for r in df.collect())
    assert key(T.classify(docs, labels)) == key(T.score(docs, *T.train(docs, labels)))
    assert T.classify(docs.where("false"), labels).count() == 0
