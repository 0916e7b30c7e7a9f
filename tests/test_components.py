import random

from slopewise.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == brute(edges)


def test_components_of_nothing_nulls_and_loops(spark):
    got = connected_components(spark.createDataFrame([(None, 3), (4, 4), (2, None)], "a long, b long"))
    assert got.collect() == []
