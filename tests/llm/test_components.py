"""Connected components against plain union-find."""

import random

import pytest

from tessera.llm import components as C


def brute(edges):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return {x: root(x) for x in group if root(x) != x}


def found(spark, edges):
    rows = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def test_random_graphs(spark):
    rng = random.Random(5)
    for nodes, links in ((8, 5), (40, 30), (200, 190)):
        edges = [(rng.randrange(-nodes, nodes), rng.randrange(-nodes, nodes)) for _ in range(links)]
        assert found(spark, edges) == brute(edges)


def test_chain_hub_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(5000, 5000 + i) for i in range(1, 2000)]
    odd = [(7, 7), (1, 2), (2, 1), (None, 3), (9999, None), (-(2**63), 2**63 - 1)]
    edges = chain + hub + odd
    random.Random(1).shuffle(edges)
    assert found(spark, edges) == brute(edges)
    assert found(spark, [(1, 1), (None, None)]) == {}
    with pytest.raises(RuntimeError):
        C.components(spark.createDataFrame(chain, "a long, b long"), most_rounds=1)
