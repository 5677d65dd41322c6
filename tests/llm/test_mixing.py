"""Mixing: exact budgets, caps, edge cases."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import mixing as M


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing the excess of full sources again and again."""
    total, full = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > cap * sizes[i] + 1e-9}
        if not over:
            return [cap * sizes[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= over


def check(docs):
    rows = M.mix(docs).collect()
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-3
    for s in order:
        assert taken[s] == int(want[s] + 1e-6)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mix(docs).collect()), key=str)
    return taken


def test_whole_table_with_a_hot_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs)
    check(docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source"))))


def test_edge_cases(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "one two", "b", 7), (3, "one two", "b", 7), (None, "x " * 5000, None, 0), (5, "é\n🎉 z", "ü", 0), (6, " \n", "z", 0), (7, "same words", "a", 10), (7, "same words", "b", 10), (7, "other words", "b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("key", F.lit("clash")).withColumn("target", F.lit(1))
    taken = check(docs)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert r.text in {x[1] for x in rows} or any((x[1] or "").startswith(r.text) and r.n_chars == len(r.text) for x in rows)
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert M.mix(docs.where("false")).count() == 0 and M.mixed_documents(docs.where("false")).count() == 0
    assert M.mixed_documents(docs.where("doc_id = 1")).count() == 0
