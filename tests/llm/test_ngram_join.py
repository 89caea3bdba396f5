import random

import numpy as np

from sightline.llm import ngram_join as nj
from sightline.llm.ngram_join import drop_near_copies, ngram_components

from .cases import empty_table, filler, odd_rows, odd_table


def shingles(t, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size=4, percent=85):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def got(spark, rows, **k):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(odd_table(spark, rows), **k).collect()), key=str)


def near_copies():
    rng = random.Random(8)
    rows, bases = [], [filler(rng.randint(3, 120), 200 + k) for k in range(10)]
    hot = filler(25, 999)
    for i in range(300):
        words = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        if rng.random() < 0.3:
            words = hot.split() + words[: rng.randrange(12)]
        rows.append((i, " ".join(words)))
    return rows


def test_odd_rows_as_brute_force(spark):
    assert got(spark, odd_rows()) == brute(odd_rows())


def test_near_copies_as_brute_force(spark):
    rows = near_copies()
    want = brute(rows)
    assert got(spark, rows) == want
    kept = {r.doc_id for r in drop_near_copies(odd_table(spark, rows)).collect()}
    assert kept == {i for i, _, c in want if i == c}


def test_other_thresholds(spark):
    rows = near_copies()[:120]
    assert got(spark, rows, size=3, percent=60) == brute(rows, 3, 60)


def test_empty_table(spark):
    assert ngram_components(empty_table(spark)).count() == 0


def test_sketches_never_claim_too_much():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = rng.integers(1, 400, 2)
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: min(n, m) // 2], rng.integers(0, 2**63, m).astype(np.uint64)]))
        sketch = [nj.sketches(np.zeros(len(v), int), v, np.array([0, len(v)])) for v in (a, b)]
        x, y = nj.least_differences(*sketch)
        assert x[0] <= len(np.setdiff1d(a, b)) and y[0] <= len(np.setdiff1d(b, a))


def test_only_texts_of_pairs_are_exchanged(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    near = spark.createDataFrame([(0, 0, 7, -1), (0, 0, 7, 2999), (0, 0, 64, 128)], "a long, b long, doc_a long, doc_b long")
    picked = {r.doc_id for r in nj._texts_of(near, texts).collect()}
    assert {7, 64, 128, 2999} <= picked and len(picked) < 50
    assert {7, 64, 128, 2999} <= {r.doc_id for r in nj._texts_of(near, texts, 64).collect()}
    assert nj._texts_of(near.where("a > 0"), texts).count() == 0


def test_sets_that_reach_the_threshold_share_a_key():
    rng = np.random.default_rng(5)
    for percent in (50, 60, 80, 85, 93, 100):
        for _ in range(150):
            n = int(rng.choice([1, 2, 3, 5, 8, 9, 26, 27, 60, 81, 250]))
            union = rng.integers(0, 2**64, n, dtype=np.uint64)
            most = n * (100 - percent) // 100  # shingles that one of the two has not
            left = rng.permutation(n)[:most]
            cut = int(rng.integers(0, most + 1))
            sets = [np.sort(np.delete(union, left[:cut])), np.sort(np.delete(union, left[cut:]))]
            late = dict(zip(union.tolist(), (rng.integers(1, 9, n) * (rng.random(n) < rng.choice([0, 0.3, 0.9, 1]))).tolist(), strict=True))
            keys = [set(nj.block_keys(np.zeros(len(v), np.int64), v, np.array([0, len(v)]), np.array([late[x] for x in v.tolist()], np.int64), percent)[0].tolist()) for v in sets]
            assert keys[0] & keys[1], (percent, n)


def test_texts_that_share_a_passage_make_few_candidates(spark, monkeypatch):
    """A tenth of each text is the same passage: no pair is near, and few may be compared."""
    made = []
    links = nj._links
    monkeypatch.setattr(nj, "_links", lambda pairs, *a: made.append(pairs.count()) or links(pairs, *a))
    passage = filler(30, 77)
    # Few in a thousand, so that no shingle of the passage counts as frequent.
    rows = [(i, (passage + " " if i < 60 else "") + filler(270, 5000 + i, tuple(f"w{i}x{k}" for k in range(10)))) for i in range(62)]
    monkeypatch.setattr(nj, "FREQUENT", 0)
    assert {c for _, _, c in got(spark, rows)} == set(range(62))
    assert sum(made) < 62 * 61 // 20, made


def test_sets_besides_their_hub_share_a_key():
    """Whatever the hub and the frequent shingles are: sets that reach the threshold meet, those of two bands on two sides."""
    rng = np.random.default_rng(6)
    near = 0
    for percent in (50, 80, 85, 93, 100):
        for _ in range(400):
            base = np.unique(rng.integers(0, 2**64, int(rng.choice([3, 9, 40, 150, 600])), dtype=np.uint64))
            extra = rng.integers(0, 2**64, len(base) // 4 + 2, dtype=np.uint64)
            take = lambda share, p: np.unique(np.concatenate((base[rng.random(len(base)) < share], extra[rng.random(len(extra)) < p])))
            lost = rng.choice([0, 0.03, 0.1])
            x, y, hub = take(1 - lost, 0.2), take(1 - lost, 0.2), take(rng.choice([0.1, 0.8, 1]), rng.choice([0, 0.3]))
            often = set(base[rng.random(len(base)) < rng.choice([0, 0.5])].tolist())
            both = len(np.intersect1d(x, y))
            if not len(x) or not len(y) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            near += 1
            keys = []
            for v in (x, y):
                shingles, pairs, sides = nj.besides(hub, v, np.array([int(i in often) for i in v.tolist()], np.int64), percent)
                keys.append((set(shingles.tolist()), dict(zip(pairs.tolist(), sides.tolist(), strict=True))))
            (a, p), (b, q) = keys
            assert a & b or any((p[k], q[k]) in ((0, 0), (1, 2), (2, 1)) for k in p.keys() & q.keys()), (percent, len(x), len(y))
    assert near > 300


def test_a_large_group_of_near_copies_makes_few_candidates(spark, monkeypatch):
    """Some copies of one text are too far from it, and from each other, to link: they meet by few pairs, not by all."""
    made = []
    links = nj._links
    monkeypatch.setattr(nj, "_links", lambda pairs, *a: made.append(pairs.count()) or links(pairs, *a))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert 60 < len({c for _, _, c in want}) < 160
    assert got(spark, rows) == want
    # 20,424 when blocks were multiplied out whatever their size.
    assert sum(made) < 16 * len(rows), made


def test_wide_blocks_as_brute_force(spark, monkeypatch):
    rows = near_copies()
    want = brute(rows)
    for wide in (0, 3):
        monkeypatch.setattr(nj, "WIDE", wide)
        assert got(spark, rows) == want
