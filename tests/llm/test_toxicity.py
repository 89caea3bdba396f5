"""The subsequence kernel against plain counting, and held-out texts in several scripts."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import toxicity
from sightline.llm.toxicity import DECAY, SPAN, START, Landmarks, Model, encode, features, packed, score_toxicity, word_symbols, word_values

from .cases import empty_table, filler, odd_rows, odd_table


def plain_vector(symbols):
    out = defaultdict(float)
    for i in range(len(symbols)):
        for j in range(i + 1, len(symbols)):
            for k in range(j + 1, len(symbols)):
                if k - i < SPAN:
                    out[symbols[i], symbols[j], symbols[k]] += DECAY ** (k - i - 2)
    return out


def plain_norm(n):
    return sum(DECAY ** (2 * (k - i - 2)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < SPAN) ** 0.5 or 1.0


WORDS = ["idiot", "idxiot", "an", "a", "élan", "привет", "приивет", "ΜΑΛΑΚΑΣ", "m0ron", "st-up.id", "漢字仮名", "abcabcabc", "zzzzzzz", "𠀀𠀁𠀂𠀃"]


def test_the_kernel_counts_common_subsequences():
    symbols, offsets = encode(WORDS)
    lists = [symbols[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert all(s[0] == START for s in lists)
    marks = Landmarks([bytes(s) for s in lists])
    got = marks.kernel(symbols, offsets)
    for a, x in enumerate(lists):
        for b, y in enumerate(lists):
            u, v = plain_vector(x), plain_vector(y)
            want = sum(u[k] * v[k] for k in u.keys() & v.keys()) / plain_norm(len(x)) / plain_norm(len(y))
            assert abs(got[a, b] - want) < 1e-5, (WORDS[a], WORDS[b])
    row, _, value = features(symbols, offsets)
    assert np.allclose(np.bincount(row, value**2, len(WORDS))[lists.index(lists[0])], sum(x * x for x in plain_vector(lists[0]).values()) / plain_norm(len(lists[0])) ** 2)
    # Folded weights give the same values as the kernel expansion.
    w = np.random.default_rng(1).normal(size=marks.fold.shape[1])
    assert np.allclose(word_values(symbols, offsets, marks.weights(w)), got @ marks.fold @ w, atol=1e-3)


def test_training_and_scoring_see_the_same_symbols():
    for word in WORDS:
        symbols, _ = encode([word])
        again, _ = packed([symbols.tobytes()])
        assert symbols.tolist() == again.tolist()
    accents, plain = encode(["Éléphant"])[0], encode(["elephant"])[0]
    assert accents.tolist() == plain.tolist()
    assert encode(["приве"])[0].tolist() != encode(["приво"])[0].tolist() and len(set(encode(["абвгдежзиклмнопрстуфхцчшщъыьэюя"])[0].tolist())) == 32


TALK = {
    "latin": (("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu", "ve", "wa"), ["idiot", "moron", "scumbag", "dummkopf"]),
    "accents": (("kä", "lo", "mí", "nù", "pe", "rî", "sø", "tu", "vé", "wa"), ["débile", "crétin", "blödmann", "imbécile"]),
    "cyrillic": (("ка", "ло", "ми", "ну", "пе", "ри", "со", "ту", "ве", "ва"), ["дурак", "идиот", "мразь", "сволочь"]),
    "greek": (("κα", "λο", "μι", "νυ", "πε", "ρι", "σο", "του", "βε", "ξα"), ["ηλίθιος", "βλάκας", "κάθαρμα", "ανόητος"]),
}


def said(n, seed, bad, kind="latin", bent=False):
    rng = random.Random(seed)
    sounds, insults = TALK[kind]
    words = filler(n, seed, sounds).split()
    words = [w + "." if rng.random() < 0.1 else w for w in words]
    for _ in range(rng.randint(1, 3) if bad else 0):
        insult = rng.choice(insults)
        if bent:
            i = rng.randrange(2, len(insult))
            insult = insult[:i] + rng.choice(["-", ".", "*", insult[i], rng.choice(sounds)[0]]) + insult[i:]
        words.insert(rng.randrange(len(words)), insult)
    return " ".join(words)


@pytest.fixture(scope="module", params=list(TALK))
def talk(request):
    kind = request.param
    return kind, Model([said(60, i, i % 5 == 0, kind) for i in range(500)], [int(i % 5 == 0) for i in range(500)])


def test_held_out_texts(talk):
    kind, model = talk
    y = np.array([i % 4 == 0 for i in range(400)])
    p = model.score(pa.array([said(40, 9000 + i, y[i], kind) for i in range(400)]))
    assert (p[y] >= 0.5).mean() >= 0.95 and (p[~y] < 0.5).mean() >= 0.97


def test_gaps_and_inserted_characters(talk):
    kind, model = talk
    p = model.score(pa.array([said(40, 7000 + i, True, kind, bent=True) for i in range(200)]))
    assert (p >= 0.5).mean() >= 0.85


def test_one_word_that_is_bent():
    model = Model([said(60, i, i % 5 == 0) for i in range(500)], [int(i % 5 == 0) for i in range(500)])
    clean = word_values(*encode(["kalomi", "nupesotu", "wariso"]), model.weights) + model.bias
    bent = word_values(*encode(["idxiot", "mor-on", "m0ron", "i.d.i.o.t", "dummmkopf", "scumbags!"]), model.weights) + model.bias
    assert bent.min() > 0 > clean.max()
    spaced = model.score(pa.array([said(40, 1, False) + " i d i o t", said(40, 1, False)]))
    assert spaced[0] >= 0.5 > spaced[1]


def test_long_texts_and_long_words():
    model = Model([said(60, i, i % 5 == 0) for i in range(500)], [int(i % 5 == 0) for i in range(500)])
    texts = [said(20_000, 1, False), said(20_000, 1, False) + " idiot moron", "x" * 100_000, "kalomi" * 200 + "scumbag", "the " * 5000]
    assert (model.score(pa.array(texts)) >= 0.5).tolist() == [False, True, False, True, False]


def test_toxicity_table(spark):
    docs = spark.createDataFrame([(i, said(40, i, i % 5 == 0)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    rows = score_toxicity(odd_table(spark), docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 0.5 for r in rows if not (r.text or "").strip())
    one_class = score_toxicity(odd_table(spark), docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in one_class} == {0.0}
    assert score_toxicity(empty_table(spark), docs, labels.where("false")).count() == 0


def test_conflicting_and_repeated_labels_are_settled(spark):
    docs = spark.createDataFrame([(i, said(40, i, i % 5 == 0)) for i in range(200)], "doc_id long, text string")
    once = [(i, int(i % 5 == 0)) for i in range(200)]
    clash = once + [(i, 0) for i in range(0, 50, 5)] + once[:20]
    want, got = ({r.doc_id: r.score for r in score_toxicity(docs, docs, spark.createDataFrame(rows, "doc_id long, toxic int").repartition(n)).collect()} for rows, n in ((once, 1), (clash, 5)))
    assert want == got


def test_training_holds_few_vectors_beside_its_matrix(monkeypatch):
    rng = random.Random(3)
    sounds = [a + b for a in "bcdfghklmnprstvwz" for b in "aeiou"]
    names = ["".join(rng.choices(sounds, k=rng.randint(3, 5))) for _ in range(30_000)]
    insults = ["x" + "".join(rng.choices(sounds, k=4)) for _ in range(20)]
    texts = [". ".join(" ".join(rng.choices(names, k=7)) for _ in range(8)) + (" you " + rng.choice(insults) if i % 3 == 0 else "") for i in range(1500)]
    solve, begin, matrix, before = toxicity.svm, Landmarks.__init__, [], []

    def landmarks(self, words):
        if not before:
            before.append(tracemalloc.get_traced_memory()[0])
            tracemalloc.reset_peak()
        begin(self, words)

    monkeypatch.setattr(Landmarks, "__init__", landmarks)
    monkeypatch.setattr(toxicity, "svm", lambda x, *rest: (matrix.append(x.nbytes), solve(x, *rest))[1])
    tracemalloc.start()
    try:
        assert Model(texts, [int(i % 3 == 0) for i in range(1500)]).weights is not None
        peak = tracemalloc.get_traced_memory()[1] - before[0]
    finally:
        tracemalloc.stop()
    assert len(matrix) == 4 and max(matrix) < 10e6
    assert peak < 50e6  # 38 MB; 68 when the vectors of all words were held


def test_blocks_of_training_have_no_say(monkeypatch):
    texts = [said(60, i, i % 5 == 0) for i in range(300)]
    toxic = [int(i % 5 == 0) for i in range(300)]
    whole = Model(texts, toxic)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    cut = Model(texts, toxic)
    assert np.allclose(whole.score(pa.array(texts)), cut.score(pa.array(texts)), atol=1e-3)
    # Sums of words' vectors, of words that stand in many blocks and of one-word sentences.
    names = [bytes(encode([w])[0]) for w in filler(200, 1).split()[:60]]
    marks = Landmarks(names[:20])
    flat = np.concatenate([np.arange(60), [5], np.arange(0, 60, 9)]).astype(np.int32)
    begin, sizes = np.array([0, 60, 61]), np.array([60, 1, 7])
    got = toxicity.sentence_vectors(marks, names, flat, begin, sizes, 2)
    want = [marks.vectors([names[i] for i in flat[a : a + n]]).sum(0) for a, n in zip(begin, sizes)]
    assert got.shape == (5, len(want[0]) + 1) and np.allclose(got[:3, :-1], want, atol=1e-3)
    assert (got[:, -1] == 1).all() and not got[3:, :-1].any()
