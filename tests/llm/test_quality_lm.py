"""Perplexities against a plain modified Kneser-Ney model, whole in memory and joined."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from sightline.llm.quality_lm import LEAST, ORDER, VOCABULARY, classify_quality, in_memory, joined_perplexities, train

from .cases import empty_table, odd_table
from .test_learned import speak


class Plain:
    """The same model as dictionaries of strings."""

    def __init__(self, texts):
        counts = Counter(t[i : i + ORDER] for t in ("\0" * (ORDER - 1) + t for t in texts) for i in range(len(t) - ORDER + 1))
        self.levels = []
        for _ in range(ORDER):
            kinds = Counter(counts.values())
            y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.5
            cut = [0] + [min(max(k - (k + 1) * y * kinds[k + 1] / kinds[k], 0.05), k - 0.05) if kinds[k] and kinds[k + 1] else 0.5 for k in (1, 2, 3)]
            total, left = defaultdict(int), defaultdict(float)
            for g, a in counts.items():
                total[g[:-1]] += a
                left[g[:-1]] += cut[min(a, 3)]
            self.levels.append((counts, cut, total, left))
            counts = Counter(g[1:] for g in counts)

    def perplexity(self, text):
        padded, sum_ = "\0" * (ORDER - 1) + text, 0.0
        for i in range(len(text)):
            g, p = padded[i : i + ORDER], 1 / VOCABULARY
            for n in range(1, ORDER + 1):
                counts, cut, total, left = self.levels[ORDER - n]
                own = g[-n:]
                if total.get(own[:-1]):
                    a = counts.get(own, 0)
                    p = (max(a - cut[min(a, 3)], 0) + left[own[:-1]] * p) / total[own[:-1]]
            sum_ += math.log(max(p, LEAST))
        return math.exp(-sum_ / len(text))


def test_perplexities_of_a_plain_model_whole_and_joined(spark):
    rng = random.Random(4)
    texts = [speak(lang, 150, i) for i, lang in enumerate(["en", "fr", "de", "ru"] * 15)] + ["a", "ab", "\U0001f600 ok", "aa" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, table = Plain(texts), train(docs, docs.select("doc_id"))
    asked = texts[:10] + texts[-4:] + [speak("en", 60, 999), "zzzz ??", "x", "\u4e2d" * 7, "".join(rng.choices("abcdefgh ", k=300))]
    want = {t: plain.perplexity(t) for t in asked}
    distinct = spark.createDataFrame([(str(i), t) for i, t in enumerate(dict.fromkeys(asked))], "digest string, text string")
    for size in (10**9, 200):
        rows = joined_perplexities(distinct, table, shard_bytes=size).join(distinct, "digest").collect()
        assert len(rows) == len(want) and all(abs(r.perplexity / want[r.text] - 1) < 1e-6 for r in rows)
    assert table.count() == table.select("n", "high", "low").distinct().count()
    from sightline.llm.quality_lm import perplexities
    from sightline.llm import text as tx
    import pyarrow as pa

    got = perplexities(*tx.utf8(pa.array(asked)), in_memory(table).log_likelihood)
    assert np.allclose(got, [want[t] for t in asked], rtol=1e-6)


def test_quality_keeps_what_sounds_like_the_trusted(spark):
    good = [(i, speak("en", 120, i), "en") for i in range(150)]
    junk = [(1000 + i, "".join(random.Random(i).choice("#$%&*!?0123XQZ ") for _ in range(200)), "en") for i in range(30)]
    docs = spark.createDataFrame(good + junk + [(2000, None, "en"), (2001, "", None), (2002, speak("en", 100, 77), None), (None, speak("en", 90, 78), "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(100)] + [(5,), (None,)], "doc_id long")
    rows = {r.doc_id: r for r in classify_quality(docs, trusted).collect()}
    assert np.mean([rows[i].kept for i in range(100, 150)]) > 0.9
    assert not any(rows[1000 + i].kept for i in range(30))
    assert not rows[2000].kept and not rows[2001].kept and rows[2000].perplexity is None
    assert rows[2002].kept and "text" in rows[2002].asDict()
    assert classify_quality(empty_table(spark), trusted).count() == 0
    untrained = classify_quality(odd_table(spark), trusted.where("false")).collect()
    assert all(r.kept == bool(r.text) for r in untrained)


def test_a_table_over_the_bound_is_joined_with_the_same_result(spark):
    docs = odd_table(spark).unionByName(odd_table(spark).where("doc_id < 7"))
    trusted = spark.createDataFrame([(1,), (5,), (6,), (7,), (8,), (12,)], "doc_id long")
    whole, joined = (sorted(((r.doc_id, r.text, r.kept, r.perplexity and round(r.perplexity, 6), r.bar and round(r.bar, 6)) for r in classify_quality(docs, trusted, model_rows=n).collect()), key=str) for n in (10**9, 0))
    assert whole == joined and len(whole) == docs.count() and any(r[3] for r in whole)


def test_clashing_names(spark):
    docs = odd_table(spark).selectExpr("*", "'a' as lang_bar", "'b' as all_bar", "'c' as __size", "'d' as __LANG", "'e' as __digest")
    for rows in (10**9, 0):
        done = classify_quality(docs, spark.createDataFrame([(5,), (7,), (8,)], "doc_id long"), model_rows=rows)
        assert {"lang_bar", "all_bar", "__size", "__LANG", "__digest"} <= set(done.columns) and done.count() == docs.count()
