import random
import re

import numpy as np
import pyarrow as pa

from sightline.llm import text as tx

RNG = random.Random(1)
TEXTS = ["", "a b  c", "Été CAFÉ x1-y2\n\nzz", None, "\t  ", "mot", *(" ".join(RNG.choice(["aa", "b", "ccc", "dé"]) for _ in range(RNG.randint(0, 300))) for _ in range(40))]


def words_of(column, separators, lower):
    out = {}
    for lo, hi, w in tx.batches_of_words(column, separators, lower):
        for r in range(hi - lo):
            out[lo + r] = [w.text(i) for i in range(w.first[r], w.first[r + 1])]
    return list(out.values())


def test_words_are_those_of_the_patterns():
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in TEXTS]
    assert words_of(pa.array(TEXTS), tx.SPACES, False) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert words_of(pa.array(TEXTS), tx.NOT_ALNUM, True) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]
    assert words_of(pa.array(TEXTS)[3:9], tx.SPACES, False) == words_of(pa.array(TEXTS), tx.SPACES, False)[3:9]


def test_hashes_depend_on_bytes_alone(monkeypatch):
    whole = [h for _, _, w in tx.batches_of_words(pa.array(TEXTS), tx.SPACES, False) for h in w.hashes().tolist()]
    monkeypatch.setattr(tx, "CHUNK_BYTES", 64)
    parts = [h for lo, hi in tx.chunks(tx.utf8(pa.array(TEXTS))[1], 64) for h in tx.find_words(*tx.utf8(pa.array(TEXTS)[lo:hi]), tx.SPACES, False).hashes().tolist()]
    assert whole == parts and len(set(whole)) == len({w for t in TEXTS for w in (t or "").split()})


def test_grams_spans_and_minima():
    h = tx.stream(500, 3)
    for size in (1, 2, 7, 25, 50):
        g = tx.grams(h, size)
        again = tx.grams(np.concatenate((tx.stream(13, 9), h)), size)[13:]
        assert len(g) == 501 - size and (g == again).all()
        assert (tx.sliding_min(h, size) == [h[i : i + size].min() for i in range(501 - size)]).all()
    lo, hi = np.array([0, 10, 100]), np.array([5, 40, 500])
    moved = tx.spans(np.concatenate((tx.stream(7, 4), h)), lo + 7, hi + 7)
    assert (tx.spans(h, lo, hi) == moved).all()


def test_winnowing_keeps_a_shared_anchor():
    shared = tx.stream(30, 5)
    a, b = np.concatenate((tx.stream(40, 6), shared, tx.stream(9, 7))), np.concatenate((tx.stream(11, 8), shared, tx.stream(50, 9)))
    ga, gb = tx.grams(a, 10), tx.grams(b, 10)
    assert set(ga[tx.winnow(ga, 21)].tolist()) & set(gb[tx.winnow(gb, 21)].tolist())
