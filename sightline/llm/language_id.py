"""Language identification of mixed-language texts.

A word is a run of letters and marks that holds a letter. The scripts of its letters narrow the candidates to the
languages that use them. Each candidate scores the word by its character bigrams and trigrams, word
ends included, under a smoothed model; Viterbi over the words of a text, with a penalty for each
switch, labels spans of one language. The text's language is the one with most letters, where those
of a language that opens and closes the text count more: others are quoted in it.

The model is fitted on a bounded sample of labelled texts (`train_rows` in all, but `lang_rows` of each
language with as many, of the `LANGUAGES` commonest), whole, weighing each language alike; its tables have a fixed size. Texts and labels of held-out rows are not read.

Defined results: texts that are null or hold no letter (category L, of any plane; marks are none) have
language `und`, a score of 0 and no spans; with nothing to learn from every text is `und`. Rows are worked on one by one, texts whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import extended

#: Training rows in all, of a language at least (if it has as many), and languages that are learnt.
TRAIN_ROWS, LANG_ROWS, LANGUAGES = 6000, 200, 400
#: Slots of the n-gram tables, and what a switch of language costs, in nats.
SLOTS = 1 << 17
SWITCH = 12.0
#: How much more the letters of a language count that both opens and closes a text.
FRAME = 3.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.005
#: Code points that there may be.
POINTS = 0x110000
SCRIPTS = ["LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "THAI", "GEORGIAN", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "ETHIOPIC"]


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter (of category L, in any plane), whether it is a mark,
    its lower case, and its script's number."""
    letter, mark = np.zeros(POINTS, bool), np.zeros(POINTS, bool)
    lower, script = np.arange(POINTS, dtype=np.uint32), np.zeros(POINTS, np.int8)
    number = {s: i + 1 for i, s in enumerate(SCRIPTS)}
    for c in range(POINTS):
        if 0x40000 <= c < 0xE0000:  # planes without characters
            continue
        kind = unicodedata.category(chr(c))[0]
        if kind == "M":
            mark[c] = True
        elif kind == "L":
            letter[c] = True
            script[c] = number.get(unicodedata.name(chr(c), "").split(" ")[0], 0)
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
    return letter, mark, lower, script


class Letters:
    """The words of some texts by code points: letters (lower case), and word and row bounds."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        letter, mark, lower, script = tables()
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # bytes that begin a code point
        bounds = heads[offsets]
        n = len(points)
        inside = letter[points]
        marks = mark[points]
        if marks.any():
            inside = inside | marks
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1]))[:n]))
        if marks.any() and len(starts):  # runs of marks alone are no words
            ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False]))[:n])) + 1
            sums = np.concatenate(([0], np.cumsum(inside & ~marks)))
            for a, b in zip(starts[bare := sums[ends] == sums[starts]], ends[bare], strict=True):
                inside[a:b] = False
            starts = starts[~bare]
        self.at = np.flatnonzero(inside)
        self.points = lower[points[self.at]].astype(np.uint64)
        self.script = script[points[self.at]]
        begins = np.zeros(n, bool)
        begins[starts] = True
        self.begins = begins[self.at]
        self.word_first = np.concatenate((np.flatnonzero(self.begins), [len(self.at)]))
        self.first = np.searchsorted(starts, bounds, "left")
        self.sizes = np.diff(self.word_first)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of each letter's bigram and trigram, and of each word's closing trigram."""
        c = self.points + np.uint64(2)
        one = np.concatenate((np.ones(1, np.uint64), c[:-1])) if len(c) else c
        one[self.begins] = 1
        two = np.concatenate((np.ones(1, np.uint64), one[:-1])) if len(c) else c
        two[self.begins] = 0
        with np.errstate(over="ignore"):
            a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
            pair = (one * a + c) * b
            triple = ((two * a + one) * b + c) * a
            last = self.word_first[1:] - 1
            close = ((one[last] * a + c[last]) * b + np.uint64(1)) * a
        shift = np.uint64(64 - SLOTS.bit_length() + 1)
        return (pair >> shift).astype(np.int64), (triple >> shift).astype(np.int64), (close >> shift).astype(np.int64)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n = len(self.langs)
        counts = np.zeros((2, n, SLOTS))
        scripts = np.zeros((n, len(SCRIPTS) + 1))
        for i, lang in enumerate(self.langs):
            raw, offsets = tx.utf8(pa.array([t for t, x in zip(texts, langs, strict=True) if x == lang], pa.string()))
            for lo, hi in tx.chunks(offsets):
                letters = Letters(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                pair, triple, close = letters.slots()
                counts[0, i] += np.bincount(pair, minlength=SLOTS)
                counts[1, i] += np.bincount(triple, minlength=SLOTS) + np.bincount(close, minlength=SLOTS)
                scripts[i] += np.bincount(letters.script, minlength=scripts.shape[1])
        share = counts / np.maximum(counts.sum(2, keepdims=True), 1)
        smooth = np.log(share + 1e-6).transpose(0, 2, 1)
        self.pair, self.triple = (np.ascontiguousarray(t, np.float32) for t in smooth)
        own = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
        own[:, ~own.any(0)] = True  # a script that no language uses narrows nothing
        self.allowed = own.T

    def word_scores(self, letters: Letters) -> np.ndarray:
        """(words, languages): mean of both models' log likelihood, less a bar for foreign scripts."""
        pair, triple, close = letters.slots()
        out = np.zeros((len(letters.sizes), len(self.langs)), np.float32)
        for lo in range(0, len(out), 100_000):  # a bounded part of the letters at a time
            hi = min(len(out), lo + 100_000)
            a, b = letters.word_first[lo], letters.word_first[hi]
            per_letter = 0.5 * self.pair[pair[a:b]] + self.triple[triple[a:b]]
            heads = letters.word_first[lo:hi] - a
            foreign = np.add.reduceat(~self.allowed[letters.script[a:b]], heads, axis=0, dtype=np.float32)
            barred = np.where(foreign > 0, foreign, 0)
            barred -= barred.min(axis=1, keepdims=True)
            out[lo:hi] = np.add.reduceat(per_letter, heads, axis=0) + self.triple[close[lo:hi]] - 20.0 * barred
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts are gone through side by side, longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")  # texts with more than t words
    before = np.concatenate(([0], np.cumsum(active)))
    row = np.arange(before[-1]) - np.repeat(before[:-1], active)
    at = first[order][row] + np.repeat(np.arange(steps), active)
    s = scores[at]
    switched = np.zeros(s.shape, bool)
    source = np.zeros(len(s), np.int16)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    last = np.zeros(len(order), np.int16)
    for t in range(steps):
        k, a = active[t], before[t]
        v = value[:k]
        if t:
            best = v.argmax(1)
            bar = v[np.arange(k), best][:, None] - penalty
            other = bar > v
            switched[a : a + k] = other
            source[a : a + k] = best
            v = np.where(other, bar, v) - bar  # kept small however long the text is
        value[:k] = v + s[a : a + k]
        end = active[t + 1] if t + 1 < steps else 0
        if end < k:
            last[end:k] = value[end:k].argmax(1)
    label = np.zeros(len(s), np.int16)
    now = last.copy()
    for t in range(steps - 1, -1, -1):
        k, a = active[t], before[t]
        label[a : a + k] = now[:k]
        jump = switched[a + np.arange(k), now[:k]]
        now[:k] = np.where(jump, source[a : a + k], now[:k])
    out = np.zeros(len(s), np.int16)
    out[at] = label
    return out


def _identify(model, text_at: int, names: list[str], penalty: float):
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        known: Model = model.value
        for whole in batches:
            raw, offsets = tx.utf8(whole.column(text_at))
            for lo, hi in tx.chunks(offsets, 4_000_000):
                batch = whole.slice(lo, hi - lo)
                letters = Letters(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = hi - lo
                langs, scores, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if len(letters.sizes) and known.langs:
                    label = viterbi(known.word_scores(letters), letters.first, penalty)
                    row = np.repeat(np.arange(n), np.diff(letters.first))
                    weight = np.bincount(row * len(known.langs) + label, letters.sizes, n * len(known.langs)).reshape(n, -1)
                    total = weight.sum(1)
                    # A language that opens and closes the text is the one that others are quoted in.
                    some = np.flatnonzero(np.diff(letters.first))
                    opens, closes = label[letters.first[some]], label[letters.first[some + 1] - 1]
                    frame = opens == closes
                    weight[some[frame], opens[frame]] *= FRAME
                    weight /= np.maximum(weight.sum(1, keepdims=True), 1)
                    best = weight.argmax(1)
                    scores = weight[np.arange(n), best]
                    langs = [known.langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
                    cut = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(label, prepend=-1))
                    for s, e in zip(cut, np.append(cut, len(row))[1:], strict=True):
                        base = letters.first[row[s]]
                        spans[row[s]].append({"lang": known.langs[label[s]], "start": int(s - base), "end": int(e - base)})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(spans, span)], names=names)

    return scan


def _sample(rows: DataFrame, total: int, least: int) -> DataFrame:
    """Of each language its part of about `total` rows, and `least` rows (all, if it has fewer), chosen by
    a hash of doc_id and text. Languages are counted first; for the rarest, rows beyond are cut."""
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = counts.select("lang", F.least(F.lit(1.0), F.greatest(F.lit(total) / F.sum("count").over(Window.partitionBy()), F.lit(least) / F.col("count"))).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return picked.select("text", "lang").limit(2 * (total + least * LANGUAGES))


def identify_languages(docs: DataFrame, training: DataFrame, train_rows: int = TRAIN_ROWS, lang_rows: int = LANG_ROWS, penalty: float = SWITCH) -> DataFrame:
    """All columns of `docs` and lang_pred, score (0 to 1: the share of the counted letters in the
    language named) and spans (language and word range). `training` has doc_id, text and lang. Columns of
    `docs` with these names are replaced."""
    docs = docs.drop("lang_pred", "score", "spans").withColumn("text", F.col("text").cast("string"))
    known = training.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = _sample(known, train_rows, lang_rows).collect()
    model = docs.sparkSession.sparkContext.broadcast(Model([r["text"] for r in rows], [r["lang"] for r in rows]))
    schema = extended(docs.schema, "lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")
    return docs.mapInArrow(_identify(model, docs.columns.index("text"), schema.names, penalty), schema)
