"""URL rules: mined rules against brute force, given rules, edge cases."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm import url_rules as U


def brute(rows, support, confidence, least, lift, sources):
    """Minimal good combinations among all of ``rows`` (tokens, rule, blocked, fold)."""
    tokens = sorted({t for r in rows for t in r[0]})
    mining = [r for r in rows if r[3] == 0 and r[0]]
    share = [r[2] for r in rows if r[3] == 1 and r[0]]
    share, good = sum(share) / max(1, len(share)), set()
    for k in (1, 2, 3):
        for items in map(frozenset, combinations(tokens, k)):
            hit = [r for r in rows if items <= r[0]]
            first, second = [[r[2] for r in hit if r[3] == f] for f in (0, 1)]
            if first and second and sum(first) >= max(support * len(mining), least) and sum(first) / len(first) >= confidence:
                held = sum(second) / len(second)
                if held >= confidence and held >= lift * share and len({r[1] for r in hit if r[2]}) >= sources:
                    good.add(items)
    return {g for g in good if not any(o < g for o in good)}


def test_mined_rules_are_all_minimal_good_ones(spark):
    rng = random.Random(2)
    one = [({"a", "b"}, True, "r1"), ({"a", "b"}, True, "r2"), ({"a", "c"}, True, "r1"), ({"a"}, False, "s"), ({"b", "d"}, True, "r3"), ({"b", "d"}, True, "r1"), ({"c"}, False, "s"), ({"e", "c"}, True, "r2"), ({"f"}, False, "s"), ({"f", "d"}, True, "r2")]
    for times in (3, 8, 20):
        rows = [(frozenset(t), rule, y, rng.randrange(2)) for t, y, rule in one for _ in range(rng.randrange(1, times))]
        df = spark.createDataFrame([(sorted(t), rule, y, f) for t, rule, y, f in rows], "tokens array<string>, rule string, blocked boolean, fold int")
        got = {frozenset(r["items"]) for r in U.mine(df, 0.05, 0.9, 2).collect()}
        assert got == brute(rows, 0.05, 0.9, 2, U.LIFT, U.SOURCES)
    assert got
    urls = spark.createDataFrame([(1, ["b", "z"]), (2, ["a"]), (3, ["a", "b", "c", "q"]), (4, [])], "page_id long, tokens array<string>")
    rules = U.mine(df, 0.05, 0.9, 2)
    kept = [frozenset(r["items"]) for r in rules.collect()]
    assert {r.page_id for r in U.matched(urls, rules).where("blocked").collect()} == {r.page_id for r in urls.collect() if any(k <= set(r.tokens) for k in kept)}


def test_tokens(spark):
    url = "https://m.Casino-Win.example.org/en/a/Big_bonus-7.html?page=2&ref=x#top"
    host, path = U.parts(F.col("url"))
    df = spark.createDataFrame([(url,), (None,)], "url string").select("url", host.alias("host"), path.alias("path"))
    got = df.select(U.tokens(F.col("host"), F.col("path"), F.col("url"))).collect()
    assert got[0][0] == ["h1=org", "h2=example", "h3=casino-win", "h4=m", "word=casino", "word=win", "dir1=en", "dir2=a", "file=big", "file=bonus", "end=html", "key=page", "key=ref"]
    assert got[1][0] == []


def test_held_out_allowed_pages_are_left_alone(spark):
    """Rules mined and tested on labels whose URL ends in an even digit block next to no allowed page of the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = U.parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", U.fitting_rule(F.col("host"), F.col("path"))).where("fit is not null")
    rows = rows.select("page_id", U.tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "fit.rule", (F.col("fit.verdict") == "block").alias("verdict"), U.fold(F.col("url")).alias("fold"))
    rules = U.mine(rows.where("page_id % 2 = 0").withColumnRenamed("verdict", "blocked"))
    assert rules.count() > 0
    found = U.matched(rows.where("page_id % 2 = 1").select("page_id", "tokens", "verdict"), rules).groupBy("verdict").agg(F.avg(F.col("blocked").cast("int")).alias("b")).collect()
    assert {r.verdict: r.b for r in found}[False] < 0.01


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/x", "http://a.example.com/en/", "http://example.com/enx", "http://sub.net/es/1?q=://x", "http://net/fr/", "http://fakenet/fr/", "https://x.org", "http://x.com?a=/b", "http://y.com#f", "http://" + "a." * 300 + "org/" + "p/" * 5000, "http://x.net/es", "http://Ü.com/é"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://x.net/es/"), (3, "http://")], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    rows = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in U.judge(pages).collect()}
    by_id = {k[0]: (*k[1:], *v) for k, v in rows.items()}
    for i in (0, 1, 2, 3):
        assert by_id[i] == ("", "", None, "allow")
    assert by_id[4] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by_id[5][2:] == ("example.com/en/", "block") and by_id[6][2:] == ("example.com/en/", "block")
    assert by_id[7][2:] == ("com/", "allow") and by_id[8] == ("sub.net", "/es/1", "net/es/", "block")
    assert by_id[9][2] == "net/fr/" and by_id[10][2] is None and by_id[12] == ("x.com", "", None, "allow")
    assert by_id[15][2] is None and by_id[None][2:] == ("net/es/", "block") and by_id[16][0] == "Ü.com"
    assert U.judge(pages.where("false")).count() == 0
