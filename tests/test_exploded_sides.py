"""Rows exploded from texts look small to the optimizer: joins of them must not broadcast either side."""

from tessera.operators import linking


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, folder):
    path = f"{folder}/texts"
    spark.createDataFrame([(d, f"In [[Link|the word {d}]] and [[Other]] too") for d in range(50)], "doc_id long, text string").write.parquet(path)
    plain, tags = linking.annotate(spark.read.parquet(path))
    return linking.with_places(linking.tokenize(plain)), tags


def test_realign_broadcasts_no_exploded_side(spark, tmp_path):
    words, tags = _texts(spark, tmp_path)
    found = linking.realign(words, tags.withColumnRenamed("link", "label"), last_only=True)
    assert "Broadcast" not in _plan(found)
    assert sorted((r.doc_id, r.pos, r.label) for r in found.collect()) == sorted(x for d in range(50) for x in ((d, 3, "Link"), (d, 5, "Other")))


def test_densify_deals_no_grams(spark, sf_small):
    from tessera.plans import catalog

    plan = _plan(catalog.queries()["str_densify_features"](spark, sf_small))
    assert "SortMergeJoin [doc_id" in plan and not any("[pos" in x and "BroadcastHashJoin" in x for x in plan.split("\n"))
    assert plan.count("Generate posexplode") == 1  # the tokens are read once, features know their grams' ends already


def test_merge_tags_broadcasts_no_exploded_side(spark, tmp_path):
    words, tags = _texts(spark, tmp_path)
    found = linking.merge_tags(words, tags.withColumnRenamed("link", "tag"))
    assert "Broadcast" not in _plan(found)
    assert found.where("tag is not null").count() == 50 * 4
