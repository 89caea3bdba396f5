import math

import numpy as np

from sightline.llm.embedding_dedup import embedding_components


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _ in rows if i is not None}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    counts = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                counts[a] += 1
                counts[b] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    for (i, _), c in zip(good, counts):
        links[i] = c
    return sorted(((i, links.get(i, 0) if i is not None else 0, find(i) if i is not None else None, True if i is None else find(i) == i) for i, _ in rows), key=str)


def vectors():
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(300):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.35, 0.5])
        rows.append((i, (v * rng.choice([1.0, 2.0])).astype(np.float32).tolist()))
    return rows


ODD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 0.0]), (1007, [1.0, 0.1]), (None, [1.0] * 16), (1008, [1.0, 0.0])]


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, kept string, n_links string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_components(df, **k).collect()), key=str)


def test_as_brute_force_with_few_and_many_cells(spark):
    rows = vectors() + ODD
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, cell_rows=20, block_rows=7) == want


def test_empty_table(spark):
    assert got(spark, []) == []


def test_tiny_and_huge_components_neither_under_nor_overflow(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [2e-200, 2e-200]), (3, [1e200, 1e200]), (4, [1.0, -1.0]), (5, [3e-300, -3e-300]), (6, [5e-324, 0.0]), (7, [1e308, 0.0])]
    done = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert done == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
