"""Graph traversal on a small graph with a cycle, a self-loop, index 0 and an isolated node, and on random graphs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import graph as G
from tessera.operators import relations as R

EDGES = [(1, 2, 0), (2, 3, 0), (3, 1, 0), (3, 4, 1), (5, 4, 0), (0, 0, 0)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame([("r", a, b, p) for a, b, p in EDGES], "prop string, src long, dst long, pos int")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "idx long")


def found(df, column="idx"):
    return {r[column] for r in df.collect()}


def test_satisfy(spark, g):
    graph = G.Graph(g)
    assert found(graph.satisfy(["r"], [4])) == {1, 2, 3, 4, 5}
    assert found(graph.satisfy(["r"], [4], 1)) == {3, 4, 5}
    assert found(graph.satisfy(["r"], [0])) == {0}
    assert graph.satisfy(["r"], [4]) is graph.satisfy(["r"], [4])  # remembered
    graph.set_bad(ids(spark, 3))
    assert found(graph.satisfy(["r"], [4])) == {4, 5}
    graph.set_bad(None, spark.createDataFrame([(3, 4)], "child long, ancestor long"))
    assert found(graph.satisfy(["r"], [4])) == {4, 5}
    graph.set_bad(ids(spark, 4))  # a bad seed is expanded, but not in the result
    assert found(graph.satisfy(["r"], [4])) == {1, 2, 3, 5}


def test_neighborhood_and_dictionary(spark, g):
    near = lambda node, k: {r.node for r in G.neighborhood(g, ids(spark, node), k).collect()}
    assert near(1, 2) == {2, 3} and near(1, 3) == {1, 2, 3, 4} and near(0, 1) == {0} and near(6, 2) == set()
    assert {r.idx: r.n for r in G.find_dictionary(g, ids(spark, 1), 2).collect()} == {2: 1, 3: 1}


def test_relations(spark, g):
    inverse = {}
    for r in sorted(R.invert(g).collect(), key=lambda r: (r.src, r.pos)):
        inverse.setdefault(r.src, []).append(r.dst)
    assert inverse == {2: [1], 3: [2], 1: [3], 4: [3, 5], 0: [0]}
    assert {r.idx: r.degree for r in R.degree(g, ids(spark, *range(7))).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 0, 5: 1, 6: 0}


def test_paths(spark, g):
    from pyspark.sql import functions as F

    paths = G.shortest_paths(g.withColumn("rel", F.lit(0)), 1, ids(spark, 4, 6))
    assert [(r.idx, r.hops, r.path) for r in paths.collect()] == [(4, 3, ["1", "r", "2", "r", "3", "r", "4"])]


def test_classify(spark):
    out, names = G.classify(ids(spark, 0, 1, 2), {"b": ids(spark, 0, 1), "a": ids(spark, 1)})
    assert {r.idx: r.class_id for r in out.collect()} == {0: 1, 1: 1, 2: 2}
    assert [r.name for r in names.orderBy("class_id").collect()] == ["a", "b", "other"]
    assert G.classify(ids(spark, 1), {"a": ids(spark, 1)})[1].count() == 1


def brute_reach(edges, seeds, steps, bad, pairs):
    seen, frontier = dict.fromkeys(seeds, 0), set(seeds)
    for step in range(1, (steps if steps is not None else 99) + 1):
        frontier = {b for a, b in edges if a in frontier and (b, a) not in pairs and b not in bad} - set(seen)
        if not frontier:
            break
        seen |= dict.fromkeys(frontier, step)
    return {n: s for n, s in seen.items() if n not in bad}


node = st.integers(0, 7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(node, node), max_size=16), st.sets(node, min_size=1, max_size=2), st.sampled_from([None, 1, 2]), st.sets(node, max_size=2), st.lists(st.tuples(node, node), max_size=2))
def test_reach_on_random_graphs(spark, edges, seeds, steps, bad, pairs):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = G.reach(df, ids(spark, *seeds), steps, ids(spark, *bad), spark.createDataFrame(pairs, "child long, ancestor long"))
    assert {r.idx: r.step for r in got.collect()} == brute_reach(edges, seeds, steps, bad, set(pairs))
