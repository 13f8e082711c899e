import random

from folioscope.operators.graph import components


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 5), (5, None), (200, 201), (201, 200), (200, 201)]
    edges += [(300 + rnd.randrange(60), 300 + rnd.randrange(60)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
