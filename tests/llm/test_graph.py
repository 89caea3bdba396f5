import random

from sightline.llm.graph import components


def test_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(900, 990)] + [(5000, 5000)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(-5, 7000), (7000, -9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
