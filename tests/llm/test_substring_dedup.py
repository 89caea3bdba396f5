import random
import re

from sightline.llm.substring_dedup import substring_dedup

from .cases import empty_table, filler, odd_rows, odd_table


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        cut = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if least[tuple(w[p : p + window])] < i:
                    cut[p : p + window] = [True] * window
        out.append((i, len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c)))
    return sorted(out, key=str)


def got(spark, rows, **k):
    done = substring_dedup(odd_table(spark, rows), **k)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in done.collect()), key=str)


def test_odd_rows_as_brute_force(spark):
    assert got(spark, odd_rows()) == brute(odd_rows(), 50)


def test_random_passages_as_brute_force(spark):
    rng = random.Random(4)
    passages = [filler(rng.randint(5, 40), 100 + k) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else filler(rng.randint(1, 15), 1000 + i * 7 + k) for k in range(rng.randint(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3:  # an edited copy
            words = text.split()
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        rows.append((i if rng.random() < 0.95 else i - 1, text))
    distinct = list({i: (i, t) for i, t in rows}.values())
    assert got(spark, distinct, window=12, gram=6) == brute(distinct, 12)


def test_keeps_other_columns_and_empty_tables(spark):
    done = substring_dedup(odd_table(spark))
    assert done.columns[:2] == ["doc_id", "text"] and {"lang", "score", "n_words", "n_removed"} <= set(done.columns)
    assert substring_dedup(empty_table(spark)).count() == 0


def test_clashing_names(spark):
    docs = odd_table(spark).selectExpr("*", "'a' as __cuts", "'b' as __cut_id", "'c' as anchor")
    done = substring_dedup(docs)
    assert {"__cuts", "__cut_id", "anchor"} <= set(done.columns) and done.count() == docs.count()
