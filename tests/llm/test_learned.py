"""Operators that learn: held-out accuracy, odd rows, and spans."""

import random

import numpy as np
import pytest

from sightline.llm.language_id import Model as Languages
from sightline.llm.language_id import identify_languages, viterbi

from .cases import empty_table, odd_table

SOUNDS = {"en": ("th", "er", "ing", "and", "the ", "of "), "fr": ("eau", "ou", "é", "le ", "que ", "tion"), "de": ("sch", "ung", "der ", "ü", "keit", "ein"), "ru": ("про", "ст", "ов", "и ", "не ", "ка")}


def speak(lang, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(SOUNDS[lang]) + (" " if rng.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speak(lang, 60, i), lang) for i, lang in enumerate(list(SOUNDS) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_texts(spark, spoken):
    test = spark.createDataFrame([(1000 + i, speak(lang, 50, 5000 + i), lang) for i, lang in enumerate(list(SOUNDS) * 20)], "doc_id long, text string, lang string")
    done = identify_languages(test, spoken).collect()
    assert np.mean([r.lang == r.lang_pred for r in done]) > 0.97
    assert all(0 <= r.score <= 1 for r in done)


def test_spans_of_a_mixed_text(spark, spoken):
    text = speak("en", 80, 1) + ". " + speak("ru", 60, 2) + ". " + speak("en", 80, 3)
    row = identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), spoken).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "en"] and row.lang_pred == "en"
    assert row.spans[0].start == 0 and row.spans[-1].end == sum(s.end - s.start for s in row.spans)


def test_languages_of_odd_rows(spark, spoken):
    done = {r.doc_id: r for r in identify_languages(odd_table(spark), spoken).collect() if r.doc_id}
    assert {done[i].lang_pred for i in (2, 3, 4)} == {"und"} and done[2].score == 0 and done[2].spans == []
    assert done[5].lang_pred in SOUNDS
    nothing = identify_languages(odd_table(spark), spoken.where("false"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert identify_languages(empty_table(spark), spoken).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores = rng.normal(size=(n + 3, 3)).astype(np.float32)
        got = viterbi(scores, np.array([0, n, n, n + 3]), 0.7)
        for a, b in ((0, n), (n, n + 3)):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert abs(value(best) - value(got[a:b].tolist())) < 1e-5


def test_letters_of_all_planes_and_marks_alone(spark, spoken):
    texts = ["́̀ ̈", "\U00020000\U00020001 \U00030000", "12 ́ !", "é", "\U0001f600"]
    rows = identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spoken).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, False, True, False, True]


def test_a_rare_language_is_learnt(spark, spoken):
    rare = spark.createDataFrame([(10_000 + i, "".join(random.Random(i).choice(["kwa ", "zulu", "ngo", "mba "]) for _ in range(40)), "sw") for i in range(4)], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "".join(random.Random(99).choice(["kwa ", "zulu", "ngo", "mba "]) for _ in range(40)))], "doc_id long, text string")
    assert identify_languages(test, spoken.unionByName(rare), train_rows=20, lang_rows=10).first().lang_pred == "sw"
