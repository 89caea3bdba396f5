"""Repeated passages across documents: seed by winnowed anchors, extend both ways, cut.

A window is `window` consecutive words of one document. A word is cut when a window that covers
it has the word sequence of a window of a document with a smaller doc_id; windows are judged on
the input. The plan never pairs documents with each other:

1. Seed. In every window the `gram`-word anchor with the smallest hash is chosen (winnowing), so
   equal windows choose equal anchors. Consecutive windows with one anchor form a run.
2. Join on anchors. Anchors met in one document only are dropped by a pre-aggregated count.
3. Extend. Runs whose whole stretch of words is the same form a class: all but its smallest
   document repeat every window of it. Only where one anchor has several classes (the ends of
   shared passages, edited copies) are the class's smallest document's windows compared one by
   one, to the left and to the right of the anchor.
4. Keep maximal repeats: neighbouring matched windows are merged and cut together.

Everything that is dealt by a key is first summed on the map side, and keys that a third of all
documents share only meet in sums or in joins that Spark can split.

Defined results: null or empty text has no words; texts under one window lose nothing; rows with
a null doc_id lose nothing and are no source; rows that share a doc_id never cut each other, and
what is found for the doc_id is cut from each of them where it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import extended, materialize, unused

WINDOW = 50
GRAM = 25


def seed_runs(words: tx.Words, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that choose the same anchor: row, anchor hash, hash of the run's words,
    and the first and last window."""
    h = words.hashes()
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return {"row": empty, "anchor": empty, "run": empty, "lo": empty, "hi": empty}
    pieces = tx.grams(h, gram)
    chosen = tx.winnow(pieces, window - gram + 1)
    row = words.row
    at = np.flatnonzero(row[: len(chosen)] == row[window - 1 :])
    if not len(at):
        return {"row": empty, "anchor": empty, "run": empty, "lo": empty, "hi": empty}
    anchor = chosen[at]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    head = np.concatenate(([0], cut))
    tail = np.concatenate((cut, [len(at)])) - 1
    lo, hi, where = at[head], at[tail], anchor[head]
    run = tx.mix(tx.spans(h, lo, hi + window) ^ (where - lo).astype(np.uint64))
    return {"row": row[lo], "anchor": tx.signed(pieces[where]), "run": tx.signed(run), "lo": lo, "hi": hi}


def _seeds(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, words in tx.batches_of_words(batch.column(1), tx.SPACES, lower=False, limit=tx.SMALL_CHUNK):
                runs = seed_runs(words, window, gram)
                if len(runs["row"]):
                    yield pa.RecordBatch.from_arrays([pa.array(runs["anchor"]), pa.array(runs["run"]), pa.array(ids[lo + runs["row"]].astype(np.int64))], names=["anchor", "run", "doc_id"])

    return scan


def _listed(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a list<struct> column: for each element its row, and its fields."""
    flat = column.flatten()
    lens = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), lens), [np.asarray(flat.field(n)) for n in names]


def _key(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = tx.mix(out ^ np.ascontiguousarray(p).astype(np.int64).view(np.uint64)) * np.uint64(5) + np.uint64(1)
    return out


def _find(want: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in want, j in have) with equal keys; have holds each key once."""
    order = np.argsort(have, kind="stable")
    at = np.searchsorted(have[order], want)
    at[at == len(have)] = 0
    hit = np.flatnonzero(have[order][at] == want) if len(have) else np.zeros(0, np.int64)
    return hit, order[at[hit]] if len(have) else hit


def _windows(window: int, gram: int):
    """One row for each window of the listed runs: its own hash beside its anchor's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            owner, (anchor, run) = _listed(batch.column(2), ["anchor", "run"])
            for lo, hi, words in tx.batches_of_words(batch.column(1), tx.SPACES, lower=False, limit=tx.SMALL_CHUNK):
                mine = np.flatnonzero((owner >= lo) & (owner < hi))
                runs = seed_runs(words, window, gram)
                hit, _ = _find(_key(runs["row"], runs["anchor"], runs["run"]), _key(owner[mine] - lo, anchor[mine], run[mine]))
                if not len(hit):
                    continue
                whole = tx.grams(words.hashes(), window)
                size = runs["hi"][hit] - runs["lo"][hit] + 1
                bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                of = np.repeat(hit, size)
                yield pa.RecordBatch.from_arrays([pa.array(runs["anchor"][of]), pa.array(tx.signed(whole[runs["lo"][of] + bit])), pa.array(ids[lo + runs["row"][of]]), pa.array(runs["run"][of]), pa.array(bit.astype(np.int64))], names=["anchor", "win", "doc_id", "run", "bit"])

    return scan


def _cut(window: int, gram: int, text_at: int, names: list[str]):
    """The last two input columns are whether rows have a list, and the list; text is replaced."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, (anchor, run, mask) = _listed(batch.column(batch.num_columns - 1), ["anchor", "run", "mask"])
            texts, totals, removed = [], [], []
            for lo, hi, words in tx.batches_of_words(batch.column(text_at), tx.SPACES, lower=False, limit=tx.SMALL_CHUNK):
                n = len(words.starts)
                keep = np.ones(n, bool)
                mine = np.flatnonzero((owner >= lo) & (owner < hi))
                if len(mine):
                    runs = seed_runs(words, window, gram)
                    hit, of = _find(_key(runs["row"], runs["anchor"], runs["run"]), _key(owner[mine] - lo, anchor[mine], run[mine]))
                    bits = mask[mine][of]
                    cover = np.zeros(n + 1, np.int64)
                    size = runs["hi"][hit] - runs["lo"][hit] + 1
                    for b in range(int(size.max()) if len(size) else 0):
                        on = np.flatnonzero((size > b) & ((bits >> b) & 1 == 1))
                        np.add.at(cover, runs["lo"][hit[on]] + b, 1)
                        np.add.at(cover, runs["lo"][hit[on]] + b + window, -1)
                    keep = np.cumsum(cover)[:n] == 0
                texts.append(tx.strings(*tx.joined(words, keep)))
                totals.append(words.counts)
                gone = np.concatenate(([0], np.cumsum(~keep)))
                removed.append(gone[words.first[1:]] - gone[words.first[:-1]])
            columns = [*batch.columns[:-1]]
            columns[text_at] = pa.concat_arrays(texts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(totals)), pa.array(np.concatenate(removed))], names=names)

    return scan


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, cuts): for each document with repeats the runs to cut, as anchor, run and the
    windows in the run (a bit mask, all ones where the whole run repeats)."""
    if not gram < window <= gram + 60:
        raise ValueError("the window may be longer than the anchor by 1 to 60 words")
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    seeds = texts.mapInArrow(tx.released(_seeds(window, gram)), "anchor long, run long, doc_id long")
    shared = (
        seeds.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("run").alias("r0"), F.max("run").alias("r1"))
        .where("lo < hi")
        .select("anchor", F.expr("r0 <> r1").alias("several"))
    )
    # Written first: Spark splits hot keys of a join between two exchanges, not of one on top of a sum.
    met = materialize(seeds.join(materialize(shared, "shared"), "anchor"), "seeds")
    classes = materialize(met.groupBy("anchor", "run", "several").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "classes")
    copies = (
        met.select("anchor", "run", "doc_id")
        .join(classes.where("lo < hi").select("anchor", "run", "lo"), ["anchor", "run"])
        .where("doc_id > lo")
        .select("doc_id", "anchor", "run", F.lit(-1).cast("long").alias("mask"))
    )
    # Only the class's smallest document is extended window by window.
    firsts = classes.where("several").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))
    windows = materialize(texts.join(firsts, "doc_id").select("doc_id", "text", "runs").mapInArrow(tx.released(_windows(window, gram)), "anchor long, win long, doc_id long, run long, bit long").distinct(), "windows")
    least = windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor", "win", "least")
    ends = (
        windows.join(least, ["anchor", "win"])
        .where("doc_id > least")
        .groupBy("doc_id", "anchor", "run")
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("mask"))
    )
    return copies.unionByName(ends).groupBy("doc_id", "anchor", "run").agg(F.expr("bit_or(mask)").alias("mask")).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "run", "mask")).alias("cuts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of `docs`, its text replaced by the kept words joined by one space, and
    n_words, n_removed. Columns of `docs` with these two names are replaced."""
    docs = docs.drop("n_words", "n_removed")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    cut_id, listed = unused(docs, "cut_id", "cuts")
    cuts = find_repeats(docs, window, gram).select(F.col("doc_id").alias(cut_id), F.col("cuts").alias(listed))
    told = docs.join(cuts, F.col("doc_id") == F.col(cut_id), "left").drop(cut_id)
    names = [*docs.columns, "n_words", "n_removed"]
    return told.mapInArrow(tx.released(_cut(window, gram, docs.columns.index("text"), names)), extended(docs.schema, "n_words long, n_removed long"))
