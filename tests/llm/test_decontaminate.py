import random
import re

from sightline.llm.decontaminate import decontaminate

from .cases import empty_table, filler, odd_rows, odd_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window):
    grams = []
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        if k is not None and n:
            grams += [(k, tuple(w[p : p + n])) for p in range(len(w) - n + 1)]
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for k, g in grams:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit[p : p + len(g)] = [True] * len(g)
                    found.add(k)
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, filler(20, 50)), (2, "Short one"), (3, None), (4, ""), (None, filler(9, 51)), (5, filler(8, 52)), (6, filler(20, 50)), (7, "x")]


def rows():
    rng = random.Random(3)
    out = odd_rows()
    for i in range(100, 140):
        source = words(rng.choice([ITEMS[0][1], ITEMS[5][1], ITEMS[4][1]]))
        a = rng.randrange(len(source))
        out.append((i, f"{filler(5, i)}, {' '.join(source[a : a + rng.randint(5, 14)]).upper()}! {filler(6, i + 1)} short-one"))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect()), key=str)


def test_as_brute_force_whatever_the_filter_lets_through(spark):
    want = brute(rows(), ITEMS, 8)
    docs = odd_table(spark, rows())
    assert got(decontaminate(docs, table(spark, ITEMS))) == want
    assert got(decontaminate(docs, table(spark, ITEMS), filter_bits=64)) == want


def test_empty_benchmark_and_empty_documents(spark):
    none = decontaminate(odd_table(spark), table(spark, []))
    assert {(r.n_hit, len(r["items"])) for r in none.collect()} == {(0, 0)}
    assert decontaminate(empty_table(spark), table(spark, ITEMS)).count() == 0


def test_excised_text_has_no_whole_window(spark):
    docs = odd_table(spark, rows())
    done = decontaminate(docs, table(spark, ITEMS), excise=True)
    again = decontaminate(done, table(spark, [ITEMS[0], ITEMS[5]]))
    assert again.where("n_hit > 0").count() == 0
    clean = {i for i, _, n, _ in brute(rows(), [ITEMS[0], ITEMS[5]], 8) if n == 0}
    before = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean}
    assert before == {(r.doc_id, r.text) for r in done.collect() if r.doc_id in clean}


def test_rows_with_one_id_are_one_item(spark):
    items = [*ITEMS, ITEMS[5], ITEMS[0], (5, filler(20, 50))]
    want = brute(rows(), items, 8)
    docs = odd_table(spark, rows())
    assert got(decontaminate(docs, table(spark, items))) == want
    assert got(decontaminate(docs, table(spark, items), filter_bits=64)) == want


def test_repeated_rows_of_an_item_in_either_order_are_one_item(spark):
    passage, other = filler(12, 60), filler(12, 61)
    for items in ([(7, passage), (7, passage), (3, other)], [(3, other), (7, passage), (7, passage)]):
        row = decontaminate(spark.createDataFrame([(1, "so " + passage)], "doc_id long, text string"), table(spark, items)).first()
        assert row["items"] == [7] and row.n_hit == 12


def test_clashing_names(spark):
    docs = odd_table(spark, rows()).selectExpr("*", "'a' as __digest", "'b' as __spans", "'c' as __FOUND_digest", "'d' as win", "'e' as at")
    done = decontaminate(docs, table(spark, ITEMS), excise=True)
    assert {"__digest", "__spans", "__FOUND_digest", "win", "at"} <= set(done.columns)
    assert got(done) == brute(rows(), ITEMS, 8)


def test_texts_are_worked_on_in_small_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from sightline.llm import decontaminate as dc
    from sightline.llm import text as tx

    parts, chunks = [], tx.chunks
    monkeypatch.setattr(tx, "chunks", lambda offsets, limit: parts.extend(chunks(offsets, limit)) or chunks(offsets, limit))
    known = type("Known", (), {"value": np.zeros(1 << 10, np.uint64)})
    batch = pa.RecordBatch.from_pydict({"digest": ["a", "b", "c"], "text": ["one two " * 40_000] * 3})
    list(dc._candidates(known, [8], 8, 4)(iter([batch])))
    assert parts == [(0, 1), (1, 2), (2, 3)]
