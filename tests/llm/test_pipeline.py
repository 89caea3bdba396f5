import corpus_pipeline
from sightline.llm.queries import ORACLE_SQL, QUERIES

from .test_decontaminate import words
from .test_ngram_join import brute as components
from .test_substring_dedup import brute as cuts

SF = "/root/testdata/sf0.001"


def test_stages_in_order_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "substrings", "benchmark", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    alone = stage["ngram_join"](spark, kept, SF).cache()
    assert {r.doc_id for r in alone.collect()} == {i for i, _, c in components(rows) if i == c}
    rows = [(r.doc_id, r.text) for r in alone.collect()]
    cut = stage["substrings"](spark, alone, SF).cache()
    want = {i: (t, gone) for i, n, gone, t in cuts(rows, 50) if not (gone and gone == n)}
    whole = dict(rows)
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t if gone else whole[i] for i, (t, gone) in want.items()}
    assert cut.columns == docs.columns
    clean = stage["benchmark"](spark, cut, SF).cache()
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[p : p + 8]) for w in items for p in range(len(w) - 7)}
    for r in clean.collect():
        w = words(r.text)
        assert not any(tuple(w[p : p + 8]) in grams for p in range(len(w) - 7))
    last = stage["sentencepiece"](spark, clean, SF)
    assert last.count() == clean.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(last.columns)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_stand_odd_rows_and_empty_tables(spark, tmp_path):
    from .cases import odd_rows

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd_rows()], columns)
    spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.where("false")):
        left = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path)).cache()
            assert rows.count() <= left, name
            left = rows.count()
            if name != "sentencepiece":
                assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_copies_of_the_stage_are_on_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    texts = [base, base + [f"x{i}" for i in range(20)], base + [f"y{i}" for i in range(30)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {i for i, _, c in components(rows, 5, 80) if i == c}
    assert want == {0, 2} and {i for i, _, c in components(rows) if i == c} == {0, 1, 2}
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF).collect()} == want
