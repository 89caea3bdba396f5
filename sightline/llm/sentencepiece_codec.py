"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

The encoder keeps an agenda of adjacent symbol pairs whose concatenation is a piece, ordered by
score and then from the left, and merges the first until none is left; what is then no piece is
spelt in bytes. No piece holds a space mark after another character, so texts are cut before each
run of space marks (and around line breaks, where no piece has any), and each distinct segment is
worked out once: short ones many at a time, as rows of one matrix, long ones with a heap.

Each Arrow batch is checked against the sentencepiece library: every text against the library's own
normalisation, and every distinct segment, when it is first met, against the library's ids for it.
As no piece spans two segments, the ids of a text are those of its segments. `agreed` tells whether
all of a text was the same; where it is not, the library's ids count.

Defined results: null text counts as empty, and an empty text has the end id alone and decodes to
an empty text. Rows are worked on one by one: repeated rows and null ids change nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import extended

SPACE = "▁"
#: Segments up to this many characters are merged side by side in a matrix.
SHORT = 48
#: Distinct segments a worker remembers before it forgets those used less than OFTEN times.
REMEMBERED, OFTEN = 250_000, 3
NONE = np.iinfo(np.int32).max


class _Index(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """A vocabulary as tables, and the segments met so far."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        self.eos = lib.eos_id()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        spelt = {i for i in range(size) if lib.is_byte(i)}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in spelt}
        pieces = {lib.id_to_piece(i): i for i in range(size) if i not in special and i not in spelt}
        order = sorted(pieces.values(), key=lambda i: (-lib.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        table = sorted((pieces[p[:k]] * size + pieces[p[k:]], rank[i], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces)
        self.size = size
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*table), (np.int64, np.int32, np.int32)))
        self.pairs = {k: (r, i) for k, r, i in table}
        self.place()
        self.pieces = pieces
        inner = {c for p in pieces for c in p.lstrip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        # Where no piece has a line break, texts may also be cut there.
        self.cut = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if "\n" not in inner else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        out = [lib.id_to_piece(i).replace(SPACE, " ").encode() if i not in special and i not in spelt else b"" for i in range(size)]
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        lens = np.array([len(x) for x in out])
        self.out, self.out_at, self.out_len = np.frombuffer(b"".join(out), np.uint8), np.cumsum(lens) - lens, lens
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(0, np.int32)
        self.lens = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)  # segments for which the library's ids were taken

    def forget_rare(self) -> None:
        """Keep what was used often, at most half of what is remembered."""
        keep = np.flatnonzero(self.uses >= OFTEN)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: REMEMBERED // 2]])
        names = list(self.index)
        lens = self.lens[keep]
        ends = np.concatenate(([0], np.cumsum(lens)))
        ids = self.ids[np.repeat(self.at[keep] - ends[:-1], lens) + np.arange(ends[-1])]
        self.index = _Index((names[k], i) for i, k in enumerate(keep.tolist()))
        self.ids, self.lens, self.at, self.uses, self.odd = ids, lens, ends[:-1], np.zeros(len(keep), np.int64), self.odd[keep]

    def place(self) -> None:
        """The table of pairs by hash: each pair in the first of its places that is free."""
        keys, ranks, merged = self.keys, self.ranks, self.merged
        self.levels = []
        while len(keys):
            size = max(8, (2 * len(keys) - 1).bit_length())
            slot = self.hashed(keys, size, len(self.levels))
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << size, -2, np.int64), np.full(1 << size, NONE, np.int32), np.zeros(1 << size, np.int32)
            for t, values in zip(table, (keys, ranks, merged)):
                t[slot[first]] = values[first]
            self.levels.append((size, *table))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, merged = keys[left], ranks[left], merged[left]

    @staticmethod
    def hashed(key: np.ndarray, size: int, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and id of each pair's concatenation."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a.astype(np.int64) * self.size + b).ravel()
        rank, merged = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for level, (size, keys, ranks, ids) in enumerate(self.levels):
            slot = self.hashed(key[todo], size, level)
            found = keys[slot]
            real = found == key[todo]
            rank[todo[real]], merged[todo[real]] = ranks[slot[real]], ids[slot[real]]
            todo = todo[~real & (found != -2)]  # an empty place ends the search
            if not len(todo):
                break
        return rank.reshape(a.shape), merged.reshape(a.shape)

    def spell(self, symbols: list[int]) -> list[int]:
        """Ids; a symbol below 0 is a character without a piece: -1 - code point."""
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(-1 - s).encode()]
        return out

    def heap_merge(self, segment: str) -> list[int]:
        """One segment of any length by a heap over a linked list of symbols."""
        get = self.pieces.get
        symbol = [get(c, -1 - ord(c)) for c in segment]
        n, size, pairs = len(symbol), self.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(i: int) -> None:
            j = after[i]
            if j < n and symbol[i] >= 0 and symbol[j] >= 0 and (found := pairs.get(symbol[i] * size + symbol[j])):
                heapq.heappush(agenda, (found[0], i, symbol[i], symbol[j], found[1]))

        for i in range(n - 1):
            add(i)
        gone = [False] * n
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], after[i] = new, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                add(before[i])
            add(i)
        return self.spell([s for s, g in zip(symbol, gone) if not g])

    def matrix_merge(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Short segments of one length as rows: each round merges each row's first pair. Gives the
        rows that are done with the same number of symbols, and their symbols, together."""
        length = len(segments[0])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, length)
        chars, back = np.unique(points, return_inverse=True)
        known = np.array([self.pieces.get(chr(c), -1 - int(c)) for c in chars], np.int32)
        symbol = known[back].reshape(points.shape)
        result = []
        live = np.arange(len(segments))
        rank, _ = self.look(symbol[:, :-1], symbol[:, 1:]) if length > 1 else (np.zeros((len(segments), 0), np.int32), None)
        while len(live):
            width = symbol.shape[1]
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)
            row = np.arange(len(live))
            done = rank[row, best] == NONE if width > 1 else np.ones(len(live), bool)
            if done.any():
                result.append((live[done], symbol[done]))
                go = ~done
                live, symbol, rank, best = live[go], symbol[go], rank[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            _, new = self.look(symbol[row, best], symbol[row, best + 1])
            columns = np.arange(width - 1)[None, :]
            symbol = np.take_along_axis(symbol, columns + (columns > best[:, None]), 1)
            symbol[row, best] = new
            columns = np.arange(width - 2)[None, :]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1) if width > 2 else np.zeros((len(live), 0), np.int32)
            for at in (best - 1, best):
                on = np.flatnonzero((at >= 0) & (at < width - 2))
                if len(on):
                    rank[on, at[on]] = self.look(symbol[on, at[on]], symbol[on, at[on] + 1])[0]
        return result

    def learn(self, start: int) -> None:
        """Work out the segments with an index of `start` and more."""
        new = list(islice(self.index, start, None))
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(new):
            by_length.setdefault(min(len(s), SHORT + 1), []).append(i)
        lens = np.zeros(len(new), np.int64)
        blocks, lists = [], []  # (segments, ids as rows), and (segment, ids) of the others
        for length, where in by_length.items():
            if length > SHORT:
                lists += [(i, self.heap_merge(new[i])) for i in where]
                continue
            where = np.array(where)
            for rows, ids in self.matrix_merge([new[i] for i in where.tolist()]):
                odd = (ids < 0).any(axis=1)
                lists += [(i, self.spell(x)) for i, x in zip(where[rows[odd]].tolist(), ids[odd].tolist())]
                blocks.append((where[rows[~odd]], ids[~odd]))
                lens[blocks[-1][0]] = ids.shape[1]
        for i, x in lists:
            lens[i] = len(x)
        at = np.cumsum(lens) - lens
        flat = np.zeros(int(lens.sum()), np.int32)
        for where, ids in blocks:
            flat[at[where][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        for i, x in lists:
            flat[at[i] : at[i] + len(x)] = x
        odd = np.zeros(len(new), bool)
        theirs = self.library_ids(new)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        wrong = sizes != lens
        told = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()))
        if not wrong.any():
            differs = np.flatnonzero(flat != told)
            wrong[np.searchsorted(at, differs, "right") - 1] = True
        else:
            ends = np.cumsum(sizes) - sizes
            wrong |= np.array([not np.array_equal(flat[a : a + n], told[b : b + m]) for a, n, b, m in zip(at, lens, ends, sizes)])
        if wrong.any():
            odd, lens = wrong, np.where(wrong, sizes, lens)
            parts = [np.array(theirs[i], np.int32) if w else flat[at[i] : at[i] + lens[i]] for i, w in enumerate(wrong)]
            flat, at = np.concatenate(parts), np.cumsum(lens) - lens
        self.at = np.concatenate((self.at, len(self.ids) + at))
        self.ids, self.lens, self.odd = np.concatenate((self.ids, flat)), np.concatenate((self.lens, lens)), np.concatenate((self.odd, odd))

    def library_ids(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of segments. It begins each text with a space mark, so a segment that does
        not begin with just one is asked for after a line break, whose ids are taken off."""
        plain = [len(s) > 1 and s[0] == SPACE and s[1] != SPACE for s in segments]
        asked = [s[1:] if p else "\n" + s.replace(SPACE, " ") for s, p in zip(segments, plain, strict=True)]
        got = self.library.encode(asked, num_threads=1)
        first = self.library.encode("\n")
        return [g if p else g[len(first) :] if g[: len(first)] == first else [] for g, p in zip(got, plain, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets) of each text, the end id last, and whether own and library's ids agree."""
        if len(self.index) > REMEMBERED:
            self.forget_rare()
        start = len(self.index)
        index, cut = self.index, self.cut
        numbers: list[int] = []
        counts = []
        for t in texts:
            own = [index[s] for s in cut.findall(SPACE + t.replace(" ", SPACE))] if t else []
            numbers += own
            counts.append(len(own))
        if len(index) > start:
            self.learn(start)
        at = np.array(numbers, np.int64)
        self.uses = np.concatenate((self.uses, np.zeros(len(index) - len(self.uses), np.int64))) + np.bincount(at, minlength=len(index))
        lens = self.lens[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        flat = self.ids[np.repeat(self.at[at] - ends[:-1], lens) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        of_text = np.diff(ends[bounds])
        strange = np.concatenate(([0], np.cumsum(self.odd[at])))
        agreed = strange[bounds[1:]] == strange[bounds[:-1]]
        offsets = np.concatenate(([0], np.cumsum(of_text + 1)))
        ids = np.full(offsets[-1], self.eos, np.int32)
        inside = np.ones(len(ids), bool)
        inside[offsets[1:] - 1] = False
        ids[inside] = flat
        plain = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        other = [i for i, (a, b) in enumerate(zip(self.library.normalize(texts), plain, strict=True)) if a != b]
        if other:  # the library reads these texts differently: its ids for the whole text
            lists = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in other:
                lists[i], agreed[i] = np.array([*self.library.encode(texts[i]), self.eos], np.int32), False
            ids, offsets = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return ids, offsets, agreed

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Pieces put together, space marks as spaces, without the one that stands first."""
        lens = self.out_len[ids]
        ends = np.concatenate(([0], np.cumsum(lens)))
        raw = self.out[np.repeat(self.out_at[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        bounds = ends[offsets]
        out = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            try:
                out.append(raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode())
            except UnicodeDecodeError:  # ids that do not come from a text
                out.append(self.library.decode(ids[offsets[k] : offsets[k + 1]].tolist()))
        return out


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def _run(model: str, text_at: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            _, offsets = tx.utf8(whole.column(text_at))
            for lo, hi in tx.chunks(offsets, tx.SMALL_CHUNK):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(text_at).fill_null("").to_pylist()
                ids, at, same = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(own.decode(ids, at), pa.string()), pa.array(same)], names=names)

    return scan


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """All columns of `docs` and ids (array<int>, the end id last), decoded and agreed. Columns of
    `docs` with these names are replaced. `model` is a path that every executor has."""
    docs = docs.drop("ids", "decoded", "agreed").withColumn("text", F.col("text").cast("string"))
    schema = extended(docs.schema, "ids array<int>, decoded string, agreed boolean")
    return docs.mapInArrow(tx.released(_run(model, docs.columns.index("text"), schema.names)), schema)
