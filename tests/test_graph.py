import random

import pytest

from trustloom.operators import graph

EDGES = [(1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]
CORE = {1: [2, 3, 4, 5, 6], 2: [1, 3, 5, 6], 3: [1, 2, 5], 4: [1, 6], 5: [1, 2, 3], 6: [1, 2, 4]}


def ranks(spark, edges, iterations, **options):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["rank"] for r in graph.pagerank(df, iterations, **options).collect()}


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_pagerank_snapshots(spark, small):
    full = {1: 13968397, 2: 13031592, 3: 1000000, 4: 1000000, 5: 1000000}
    assert ranks(spark, EDGES, 20, small=small) == full
    assert ranks(spark, EDGES[1:], 20, small=small) == full | {1: 4333332, 2: 1000000}


def test_both_ways_agree_on_multigraphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(20), r.randrange(25)) for _ in range(150)]
    for n in (1, 3, 9):
        assert ranks(spark, edges, n) == ranks(spark, edges, n, small=0)
    df = spark.createDataFrame(edges, "src long, dst long")
    for k in (3, 5, 7):
        a, b = graph.k_core(df, k).collect(), graph.k_core(df, k, small=0).collect()
        assert sorted(a) == sorted(b)


def test_fixpoint(spark):
    edges = [(1, 2), (2, 3)]
    want = {1: 1000000, 2: 1833333, 3: 2527777}
    assert ranks(spark, edges, 0) == want == ranks(spark, edges, 0, small=0)


def test_k_core(spark):
    df = spark.createDataFrame([(a, b) for a, bs in CORE.items() for b in bs], "src long, dst long")
    assert {r["node"] for r in graph.k_core(df, 3).collect()} == {1, 2, 3, 5}


def test_empty_and_null_edges(spark):
    assert ranks(spark, [], 5) == {}
    assert ranks(spark, [(None, 1), (1, None)], 5) == {}
    assert graph.k_core(spark.createDataFrame([], "src long, dst long"), 2).collect() == []
