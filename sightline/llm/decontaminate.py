"""Benchmark decontamination: winnowed fingerprints, joined, and hits extended.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. A window is
`window` consecutive words of a benchmark item; an item with fewer words, but not none, is one
window, and its own fingerprint. Of each other window the smallest `gram`-word hash is its fingerprint
(winnowing), so a window that stands in a document always shares one with it.

1. Texts and items give their fingerprints. A bit filter of the items' fingerprints, of a fixed size,
   leaves most of the texts' behind; a full filter leaves none behind and changes no result.
2. The fingerprints left are joined with the items' by equality.
3. Each shared fingerprint is extended to the windows of the text that chose it, and these are joined
   with the items' windows on all their words. Every window that occurs is found so.
4. Hits are summed by text: a text that stands in many rows is worked out once, and its rows take the
   result by the text's digest.

Nothing of the benchmark goes to the driver but the filter; which side of a join is sent where is left
to the planner, which sees the sizes of the written tables.

Defined results: null or empty text has no words and no hits; empty items and items with a null
text match nothing; items with a null id are left out; equal items each count, rows with one id are
one item; repeated rows of documents each get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import extended, materialize, unused

WINDOW = 8
GRAM = 4
#: Bits of the filter of fingerprints.
FILTER_BITS = 1 << 24
#: Words as regular expression, either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def runs_of_windows(words: tx.Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first window, last window) of each run of windows that choose the same place."""
    none = np.zeros(0, np.int64)
    row = words.row
    if len(h) < window:
        return none.astype(np.uint64), none, none
    pieces = tx.grams(h, gram)
    chosen = tx.winnow(pieces, window - gram + 1)
    at = np.flatnonzero(row[: len(chosen)] == row[window - 1 :])
    if not len(at):
        return none.astype(np.uint64), none, none
    place = chosen[at]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(at) != 1))))
    tail = np.append(head, len(at))[1:] - 1
    return pieces[place[head]], at[head], at[tail]


def _items(window: int, gram: int):
    """(n, print, win, item_id) of every window of the items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, _, words in tx.batches_of_words(batch.column(1), tx.NOT_ALNUM, lower=True):
                h, row = words.hashes(), words.row
                prints, first, last = runs_of_windows(words, h, window, gram)
                at, of = _spread(first, last)
                found = [(np.full(len(at), window), prints[of], tx.grams(h, window)[at] if len(at) else h[:0], ids[lo + row[at]])]
                for n in range(1, window):
                    few = np.flatnonzero(words.counts == n)
                    own = tx.grams(h, n)[words.first[few]] if len(few) else h[:0]
                    found.append((np.full(len(few), n), own, own, ids[lo + few]))
                n, prints, wins, item = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"n": n.astype(np.int32), "print": tx.signed(prints), "win": tx.signed(wins), "item_id": item.astype(np.int64)})

    return scan


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    size = last - first + 1
    of = np.repeat(np.arange(len(size)), size)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


def _bit(n: np.ndarray | int, prints: np.ndarray, size: int) -> np.ndarray:
    """Which of a filter's `size` bits stands for each fingerprint."""
    with np.errstate(over="ignore"):
        return (tx.mix(prints + np.asarray(n).astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def _filter_words(size: int):
    """The filter's bits as (place, 64 bits), one row a place and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = _bit(np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), size)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        where = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"place": where.astype(np.int32), "bits": tx.signed(bits[where])})

    return scan


def _candidates(known, sizes: list[int], window: int, gram: int):
    """(digest, n, print, at, wins): fingerprints of texts that the filter lets through, with the place of
    the first window around each and all those windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value

        def likely(n: int, prints: np.ndarray) -> np.ndarray:
            at = _bit(n, prints, 64 * len(bits))
            return np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))

        for batch in batches:
            for lo, hi, words in tx.batches_of_words(batch.column(1), tx.NOT_ALNUM, lower=True, limit=tx.SMALL_CHUNK):
                h, row = words.hashes(), words.row
                for n in sizes:
                    if n == window:
                        prints, first, last = runs_of_windows(words, h, window, gram)
                        on = likely(n, prints)
                        prints, first, last = prints[on], first[on], last[on]
                    else:
                        prints = tx.grams(h, n)
                        first = np.flatnonzero(row[: len(prints)] == row[n - 1 :]) if len(prints) else np.zeros(0, np.int64)
                        first = first[likely(n, prints[first])]
                        prints, last = prints[first], first
                    if not len(first):
                        continue
                    at, _ = _spread(first, last)
                    wins = words_hash(h, at, n)
                    ends = np.concatenate(([0], np.cumsum(last - first + 1))).astype(np.int32)
                    mine = row[first]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(lo + mine)), pa.array(np.full(len(first), n, np.int32)), pa.array(tx.signed(prints)), pa.array(first - words.first[mine]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tx.signed(wins)))],
                        names=["digest", "n", "print", "at", "wins"],
                    )

    return scan


def words_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """What grams() gives at the positions `at`, computed for those alone."""
    table = h[at[:, None] + np.arange(n)[None, :]]
    with np.errstate(over="ignore"):
        powers = tx.powers(tx.WORD_STEP, n)[::-1]
        out = (table * powers[None, :]).sum(axis=1, dtype=np.uint64)
        return tx.mix(out + np.uint64(n))


def find_hits(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(digest, n_hit, spans, items) of each text with hits: `texts` has digest and text. Spans are the
    places (at, n words) of the windows that occur, items the ids of their items."""
    spark = texts.sparkSession
    real = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(real.mapInArrow(_items(window, gram), "n int, print long, win long, item_id long").distinct(), "items")
    prints = items.select("n", "print").distinct()
    bits = np.zeros(filter_bits // 64, np.uint64)  # a row for each of its words at most
    for r in prints.mapInArrow(_filter_words(filter_bits), "place int, bits long").groupBy("place").agg(F.expr("bit_or(bits)").alias("bits")).toPandas().itertuples():
        bits[r.place] = np.int64(r.bits).view(np.uint64)
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # one for each length of a window
    seeds = texts.mapInArrow(tx.released(_candidates(spark.sparkContext.broadcast(bits), sizes, window, gram)), "digest string, n int, print long, at long, wins array<long>")
    shared = seeds.join(prints, ["n", "print"], "left_semi")
    around = shared.select("digest", "n", "at", F.posexplode("wins").alias("k", "win")).selectExpr("digest", "n", "at + k as at", "win")
    hits = materialize(around.join(items.select("n", "win").distinct(), ["n", "win"], "left_semi").distinct(), "hits")
    spans = hits.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))  # at most one a word and length
    covered = "aggregate(spans, struct(0L as upto, 0L as total), (s, x) -> struct(greatest(s.upto, x.at + x.n) as upto, s.total + greatest(0L, x.at + x.n - greatest(s.upto, x.at)) as total)).total"
    named = hits.select("digest", "n", "win").distinct().join(items.select("n", "win", "item_id").distinct(), ["n", "win"]).groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return spans.join(named, "digest").select("digest", F.expr(covered).alias("n_hit"), "spans", "items")


def _cut(text_at: int, spans_at: int, window: int, names: list[str]):
    """Takes the words of whole windows out of the text; the spans' column goes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, spans = [], batch.column(spans_at).to_pylist()
            for lo, hi, words in tx.batches_of_words(batch.column(text_at), tx.NOT_ALNUM, lower=True, limit=tx.SMALL_CHUNK):
                gone = np.zeros(len(words.starts), bool)
                for r in range(lo, hi):
                    for span in spans[r] or ():
                        if span["n"] == window:
                            at = words.first[r - lo] + span["at"]
                            gone[at : at + window] = True
                texts += _excised(batch.column(text_at).slice(lo, hi - lo).to_pylist(), words, gone)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            del columns[spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def _excised(texts: list, words: tx.Words, gone: np.ndarray) -> list:
    out = list(texts)
    base = 0
    for r, text in enumerate(texts):
        size = len((text or "").encode())
        mine = np.flatnonzero(gone[words.first[r] : words.first[r + 1]]) + words.first[r]
        if len(mine):
            raw, at, parts = text.encode(), 0, []
            for group in np.split(mine, np.flatnonzero(np.diff(mine) != 1) + 1):
                a, b = int(words.starts[group[0]]) - base, int(words.ends[group[-1]]) - base
                parts.append(raw[at:a])
                at = b
            out[r] = b"".join([*parts, raw[at:]]).decode()
        base += size
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, excise: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """All columns of `docs` and n_words, n_hit, items (ids of the items with windows that occur,
    array<long>). With `excise`, words of whole-window hits are taken out of the text. Columns of `docs`
    with these names are replaced."""
    docs = docs.drop("n_words", "n_hit", "items").withColumn("text", F.col("text").cast("string"))
    digest, found_digest, spans = unused(docs, "digest", "found_digest", "spans")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn(digest, F.md5(text.cast("binary")))
    found = find_hits(docs.select(F.col(digest).alias("digest"), "text").where("text is not null"), benchmark, window, gram, filter_bits)
    # Written first: Spark splits hot keys of a join between two exchanges, not of one on top of a sum.
    found = materialize(found.select(F.col("digest").alias(found_digest), "n_hit", F.col("spans").alias(spans), "items"), "found")
    # The text takes no part in the exchange where nothing after it needs it.
    counted = docs.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long")).withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))
    out = counted.join(found, F.col(digest) == F.col(found_digest), "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<long>"))})
    plain = out.drop(digest, found_digest, spans)
    if not excise:
        return plain
    whole = out.select(*plain.columns, spans)
    return whole.mapInArrow(tx.released(_cut(whole.columns.index("text"), len(whole.columns) - 1, window, plain.columns)), plain.schema)
