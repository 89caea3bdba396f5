"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over all common subsequences of three symbols, decay ** gaps of both
places, within a span of `SPAN` symbols, divided by norms that depend on the words' lengths. Gaps
make it tolerate inserted characters; marks between letters are dropped, letters written as digits
are read as letters, and runs of single letters are read as one word. A word's start is a symbol.
Symbols come from code points, the same way in training and in scoring: accents are taken off, a-z have
symbols of their own and the letters of other scripts share `SYMBOLS` less 27, neighbours of an alphabet
never the same one. The kernel of two sentences sums that of their words.

Training takes a bounded sample of labelled texts, whole, cut into sentences (at most `SENTENCE` words
each); copies of a sentence count once. Sentences of texts of class 0 are negative. Of a text of class 1
some sentence is positive, which one is not known: the machine is trained with the sentences that say
most, and trained anew with the ones it then takes for positive, `ROUNDS` times, each time with the
negative ones that came nearest. Landmarks are the words that set the sentences of the two classes apart
most, and common ones. The machine is linear over the landmarks, so all of it folds into one weight for
each three-symbol subsequence. A text's score is a logistic function, fitted on the sampled texts, of its
highest sentence, its highest word and the number of words over the margin.

Defined results: null and empty texts have no words and get the score of a text without a suspect
word; if the sample lacks a class, every score is the share of class 1 in it, 0 without rows; a doc_id
labelled both ways counts as toxic, repeated labels once. Rows are worked on one by one, texts whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .samples import sampled
from .scratch import extended

#: Labelled texts of each class that are sampled.
TOXIC_ROWS, OTHER_ROWS = 1000, 2500
SPAN, DECAY = 7, 0.6
LANDMARKS = 384
#: Rounds of training, negative sentences kept at random for each, and the nearest that each adds.
ROUNDS, EASY, HARD = 4, 15_000, 6_000
#: a-z are 0-25, then the word's start, then all other letters.
START, OTHER, SYMBOLS = 26, 27, 128
#: Code points that are looked up; those beyond have a symbol by their number.
PLANE = 0x10000
#: Symbols of a word that are looked at together; longer words are cut into overlapping parts.
LONGEST = 28
#: Words of a sentence; a longer one is cut.
SENTENCE = 12
TRIPLES = [(0, j, k) for k in range(2, SPAN) for j in range(1, k)]
#: Characters read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Rows of vectors that training works on at a time beside the matrix it solves.
BLOCK = 4096
#: Where values end that a text's logistic function is given.
LEAST, MOST, MANY = -3.0, 2.0, 50


@cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point; 255: dropped."""
    out = np.full(PLANE, 255, np.uint8)
    for c in range(0xAA, PLANE):
        if 0xD800 <= c < 0xE000:
            continue
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if unicodedata.category(base)[0] == "L":
            p = ord(base)
            out[c] = p - 97 if 97 <= p < 123 else OTHER + p % (SYMBOLS - OTHER)
    for i in range(26):
        out[97 + i] = out[65 + i] = i
    for k, v in LOOKALIKES.items():
        out[ord(k)] = ord(v) - 97
    return out


def word_symbols(words: tx.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of the chosen words, each begun by START."""
    lens = words.ends[which] - words.starts[which]
    before = np.concatenate(([0], np.cumsum(lens)))
    at = np.repeat(words.starts[which] - before[:-1], lens) + np.arange(before[-1])
    raw = words.data[at]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[before]  # where each word's code points begin
    s = symbol_table()[np.minimum(points, PLANE - 1)]
    far = points >= PLANE
    s[far] = OTHER + points[far] % (SYMBOLS - OTHER)
    keep = s != 255
    kept = np.concatenate(([0], np.cumsum(keep)))[heads]
    offsets = kept + np.arange(len(kept))
    out = np.full(offsets[-1], START, np.uint8)
    inside = np.ones(len(out), bool)
    inside[offsets[:-1]] = False
    out[inside] = s[keep]
    return out, offsets


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = tx.find_words(*tx.utf8(pa.array(strings, pa.string())), tx.SPACES, False)
    return word_symbols(words, np.arange(len(words.starts)))


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in words])))


def parts(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and overlapping parts of long words: (word, start, end)."""
    sizes = np.diff(offsets)
    word = [np.flatnonzero(sizes <= LONGEST)]
    lo, hi = [offsets[:-1][word[0]]], [offsets[1:][word[0]]]
    for w in np.flatnonzero(sizes > LONGEST):
        begin = np.arange(offsets[w], offsets[w + 1] - LONGEST // 2, LONGEST // 2)
        word.append(np.full(len(begin), w))
        lo.append(begin)
        hi.append(np.minimum(begin + LONGEST, offsets[w + 1]))
    return np.concatenate(word), np.concatenate(lo), np.concatenate(hi)


def triples(block: np.ndarray):
    """For words of one length, as rows: (key of each row's subsequence, its weight)."""
    n = block.shape[1]
    block = block.astype(np.int32)
    for i in range(n - 2):
        for _, j, k in TRIPLES:
            if i + k < n:
                yield (block[:, i] * SYMBOLS + block[:, i + j]) * SYMBOLS + block[:, i + k], DECAY ** (k - 2)


def norm(n: int) -> float:
    return float(np.sqrt(sum(DECAY ** (2 * (k - 2)) for i in range(n - 2) for _, _, k in TRIPLES if i + k < n))) or 1.0


NORMS = [norm(n) for n in range(LONGEST + 1)]


def by_length(symbols: np.ndarray, offsets: np.ndarray, step: int = 50_000):
    """Parts of words, some of one length at a time: (words, parts' numbers, symbols as rows, norm)."""
    word, lo, hi = parts(symbols, offsets)
    sizes = hi - lo
    for n in np.unique(sizes[sizes >= 3]):
        rows = np.flatnonzero(sizes == n)
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            yield word[own], own, symbols[lo[own][:, None] + np.arange(n)[None, :]], NORMS[n]


def features(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of words in the kernel's feature space: (word, key, value) of what is not zero."""
    word, key, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for w, _, block, scale in by_length(symbols, offsets):
        for k, weight in triples(block):
            word.append(w)
            key.append(k)
            value.append(np.full(len(w), weight / scale))
    word, key, value = np.concatenate(word), np.concatenate(key), np.concatenate(value)
    both, at = np.unique(word * SYMBOLS**3 + key, return_inverse=True)
    return both // SYMBOLS**3, (both % SYMBOLS**3).astype(np.int32), np.bincount(at, value, len(both))


class Landmarks:
    """The kernel of any words with some chosen ones."""

    def __init__(self, words: list[bytes]):
        row, key, value = features(*packed(words))
        self.keys, at = np.unique(key, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, len(words)), np.float32)
        self.table[at, row] = value
        self.place = np.full(SYMBOLS**3, len(self.keys), np.int32)
        self.place[self.keys] = np.arange(len(self.keys))
        own, vector = np.linalg.eigh((self.table.T @ self.table).astype(np.float64))
        on = own > 1e-6 * own.max()
        #: From kernel values to coordinates in which the landmarks' kernel is the dot product.
        self.fold = (vector[:, on] / np.sqrt(own[on])).astype(np.float32)

    def kernel(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(words, landmarks); a long word's is that of all its parts."""
        out = np.zeros((len(offsets) - 1, self.table.shape[1]), np.float32)
        for word, _, block, scale in by_length(symbols, offsets, 4096):
            total = np.zeros((len(word), out.shape[1]), np.float32)
            for key, weight in triples(block):
                at = self.place[key]
                on = np.flatnonzero(at < len(self.keys))
                total[on] += self.table[at[on]] * np.float32(weight)
            np.add.at(out, word, total / np.float32(scale))
        return out

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """The words' coordinates."""
        return self.kernel(*packed(words)) @ self.fold

    def weights(self, w: np.ndarray) -> np.ndarray:
        """A linear machine over the coordinates as one weight for each subsequence."""
        out = np.zeros(SYMBOLS**3, np.float32)
        out[self.keys] = self.table[:-1] @ (self.fold @ w).astype(np.float32)
        return out


def word_values(symbols: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each word adds to its sentence: its highest part; 0 for words without subsequences."""
    out = np.full(len(offsets) - 1, -np.inf, np.float32)
    for word, _, block, scale in by_length(symbols, offsets):
        total = np.zeros(len(word), np.float32)
        for key, weight in triples(block):
            total += np.float32(weight) * weights[key]
        np.maximum.at(out, word, total / np.float32(scale))
    out[np.isneginf(out)] = 0
    return out


def sentences(words: tx.Words) -> np.ndarray:
    """First word of each sentence: a text's first, the first after a full stop or a line's end, and of
    what is longer than SENTENCE words every so many."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(words.data == 10)))
    begins = np.zeros(n, bool)
    begins[words.first[:-1][words.counts > 0]] = True
    begins[1:] |= lines[words.starts[1:]] > lines[words.starts[:-1]]
    last = words.data[words.ends[:-1] - 1]
    begins[1:] |= (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    begins[1:] |= (last == 0x82) & (words.ends[:-1] - words.starts[:-1] >= 3) & (words.data[np.maximum(words.ends[:-1] - 2, 0)] == 0x80)
    head = np.flatnonzero(begins)
    inside = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    return np.flatnonzero(inside % SENTENCE == 0)


def spelt_out(words: tx.Words, single: np.ndarray) -> list[tuple[int, str]]:
    """(first word, word) for each run of four or more single letters of one text."""
    out = []
    row = words.row
    at = np.flatnonzero(single)
    if len(at) < 4:
        return out
    for group in np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1):
        if len(group) >= 4:
            out.append((int(group[0]), "".join(words.text(w) for w in group)))
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin. The last
    column of x is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = np.flatnonzero(y * (x @ w.astype(x.dtype)) < 1)
        h, to = ridge.copy(), np.zeros(len(w))
        for lo in range(0, len(on), BLOCK):
            some = on[lo : lo + BLOCK]
            scale = np.sqrt(cost * weight[some])
            own = x[some] * scale[:, None].astype(x.dtype)
            h += own.T @ own
            to += own.T @ (y[some] * scale).astype(x.dtype)
        new = np.linalg.solve(h, to)
        if np.abs(new - w).max() < 1e-4 * max(1.0, np.abs(new).max()):
            w = new
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def telling_words(names: list[bytes], n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Of each word, in n1 sentences of texts of class 1 and n0 of others, how far it is from chance (a
    log likelihood ratio) with all words of the same beginning, of four symbols and more; 0 where no
    beginning stands out more than the best of as many random ones would."""
    heads: dict[bytes, list[float]] = {}
    met = np.flatnonzero(n1 > 0)
    for i in met:
        for k in range(5, len(names[i]) + 1):
            c = heads.setdefault(names[i][:k], [0.0, 0.0])
            c[0] += n1[i]
    for i in np.flatnonzero(n0 > 0):
        for k in range(5, len(names[i]) + 1):
            c = heads.get(names[i][:k])
            if c is None:
                break
            c[1] += n0[i]
    share = n1.sum() / max(n1.sum() + n0.sum(), 1)
    bar = np.log(len(heads) + 1) + 3
    gain = {}
    for h, (a, b) in heads.items():
        rate = a / (a + b)
        if rate > 0.5 + share / 2:
            g = a * np.log(rate / share) + (b * np.log((1 - rate) / (1 - share)) if b else 0.0)
            if g > bar:
                gain[h] = g
    out = np.zeros(len(names))
    for i in met:
        if n1[i] > 2 * n0[i]:
            out[i] = max((gain.get(names[i][:k], 0.0) for k in range(5, len(names[i]) + 1)), default=0.0)
    return out


def sentence_vectors(marks: Landmarks, names: list[bytes], flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, more: int) -> np.ndarray:
    """The sum of the vectors of each sentence's words, then `more` rows to be filled; the last column is 1.
    Words are taken a block at a time, so that no more of their vectors are held."""
    x = np.zeros((len(sizes) + more, marks.fold.shape[1] + 1), np.float32)
    x[:, -1] = 1
    first = np.cumsum(sizes) - sizes
    used, word = np.unique(flat[np.repeat(begin - first, sizes) + np.arange(sizes.sum())], return_inverse=True)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(word // BLOCK, kind="stable")
    word, sentence = word[order].astype(np.int32), sentence[order]
    ends = np.searchsorted(word // BLOCK, np.arange(-(-len(used) // BLOCK)), "right")
    lo = 0
    for block, end in enumerate(ends):
        z = marks.vectors([names[i] for i in used[block * BLOCK : (block + 1) * BLOCK]])
        for a in range(lo, end, BLOCK):
            own = sentence[a : min(a + BLOCK, end)]
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            x[own[head], :-1] += np.add.reduceat(z[word[a : a + len(own)] - block * BLOCK], head, axis=0)
        lo = end
    return x


class Model:
    """Folded weights of the machine and the logistic function of a text."""

    def __init__(self, texts: list[str], toxic: list[int], landmarks: int = LANDMARKS):
        self.prior = float(np.mean(toxic)) if toxic else 0.0
        self.weights: np.ndarray | None = None
        if len(set(toxic)) < 2 or not self._train(texts, np.array(toxic), landmarks):
            return
        found = self.measure(pa.array(texts, pa.string()))
        self.center, self.spread = found.mean(0), found.std(0) + 1e-6
        f = np.hstack([(found - self.center) / self.spread, np.ones((len(found), 1))])
        self.logit = np.zeros(f.shape[1])
        t = np.array(toxic, float)
        for _ in range(50):  # ridge-penalised Newton steps
            p = 1 / (1 + np.exp(-np.clip(f @ self.logit, -30, 30)))
            h = (f * (p * (1 - p) + 1e-9)[:, None]).T @ f + 0.05 * np.eye(len(self.logit))
            self.logit += np.linalg.solve(h, f.T @ (t - p) - 0.05 * self.logit)

    def _train(self, texts: list[str], toxic: np.ndarray, landmarks: int) -> bool:
        # Words by their symbols, so the same however they are spelt; sentences as runs of them.
        spell: dict[bytes, int] = {}
        ids, heads, owners, keys, n = [], [], [], [], 0
        for lo, _, words in tx.batches_of_words(pa.array(texts, pa.string()), tx.SPACES, False):
            _, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            symbols, offsets = word_symbols(words, where)
            raw = symbols.tobytes()
            known = np.array([spell.setdefault(raw[a:b], len(spell)) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
            head = sentences(words)
            ids.append(known[back].astype(np.int32))
            keys.append(tx.spans(tx.mix(known[back].astype(np.uint64) + np.uint64(1)), head, np.append(head, len(back))[1:]))
            heads.append(head + n)
            owners.append(lo + words.row[head])
            n += len(back)
        if not n:
            return False
        flat, begin, owner, key = np.concatenate(ids), np.concatenate(heads), np.concatenate(owners), np.concatenate(keys)
        del ids, heads, owners, keys
        tx.release()
        end = np.append(begin, n)[1:]
        y = toxic[owner] > 0
        # Copies of a sentence count once, for class 0 if any stands in a text of it.
        order = np.lexsort((begin, y, key))
        first = order[np.concatenate(([True], np.diff(key[order]) != 0))]
        first.sort()
        sizes, owner, y = (end - begin)[first], owner[first], y[first]
        flat = flat[np.repeat(begin[first] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        begin = np.cumsum(sizes) - sizes
        if not y.any() or y.all():
            return False
        # In how many sentences of each class a word stands.
        pair = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(spell) + flat)
        flat, sizes = (pair % len(spell)).astype(np.int32), np.bincount(pair // len(spell), minlength=len(sizes))
        begin = np.cumsum(sizes) - sizes
        n1, n0 = (np.bincount((pair % len(spell))[y[pair // len(spell)] == c], minlength=len(spell)).astype(float) for c in (True, False))
        names = list(spell)
        del pair, order, key, first, end, owner, spell
        gain = telling_words(names, n1, n0)
        symbols, offsets = packed(names)
        telling = np.flatnonzero(gain > 0)
        if not len(telling):
            return False
        long = np.array([len(s) > 3 for s in names])
        chosen = telling[np.argsort(-n1[telling], kind="stable")[: landmarks // 2]]
        common = np.argsort(-np.where(long, n0, 0), kind="stable")[: landmarks // 16]
        chosen = np.union1d(chosen, common)
        rng = np.random.default_rng(5)
        sure = np.flatnonzero(y & (np.maximum.reduceat(gain[flat], begin) > 0))
        positive = sure
        negative = np.flatnonzero(~y)
        easy = negative if len(negative) <= EASY else np.sort(rng.choice(negative, EASY, replace=False))
        nearest = np.zeros(0, np.int64)
        for step in range(ROUNDS):
            tx.release()  # the driver's JVM stands beside it
            marks = Landmarks([names[i] for i in chosen])
            rows = np.unique(np.concatenate((positive, easy, nearest)))
            chosen_word, bent = self._bent(names, flat, begin, sizes, positive, gain, rng)
            x = sentence_vectors(marks, names, flat, begin[rows], sizes[rows], len(bent))
            for lo in range(0, len(bent), BLOCK):
                own = chosen_word[lo : lo + BLOCK]
                taken = marks.vectors(bent[lo : lo + BLOCK]) - marks.vectors([names[w] for _, w in own])
                x[len(rows) + lo : len(rows) + lo + len(own), :-1] = x[np.searchsorted(rows, [r for r, _ in own]), :-1] + taken
            target = np.concatenate((np.where(y[rows], 1.0, -1.0), np.ones(len(bent))))
            w, self.bias = svm(x, target, np.where(target > 0, 1.0, max((target > 0).sum() / max((target < 0).sum(), 1), 0.25)))
            self.weights = marks.weights(w)
            del marks, x
            worth = word_values(symbols, offsets, self.weights)
            of_sentence = np.add.reduceat(worth[flat], begin) + self.bias
            if step + 1 < ROUNDS:
                positive = np.union1d(sure, np.flatnonzero(y & (of_sentence > 0)))
                nearest = np.union1d(nearest, negative[np.argsort(-of_sentence[negative], kind="stable")[:HARD]])
                # Words of negative sentences that the machine takes for telling become landmarks too.
                wrong = np.where(long & (n0 > 0) & (n0 >= n1), worth, -np.inf)
                hard = np.argsort(-wrong, kind="stable")[: landmarks // 6]
                chosen = np.union1d(chosen, hard[np.isfinite(wrong[hard])])
        return True

    @staticmethod
    def _bent(names, flat, begin, sizes, positive, gain, rng) -> tuple[list[tuple[int, int]], list[bytes]]:
        """(sentence, its most telling word) of positive sentences, and that word with a letter put in."""
        which, out = [], []
        for r in positive:
            own = flat[begin[r] : begin[r] + sizes[r]]
            w = int(own[gain[own].argmax()])
            s = names[w]
            if len(s) > 4 and gain[w] > 0:
                i = int(rng.integers(2, len(s)))
                out.append(s[:i] + bytes([int(rng.integers(26))]) + s[i:])
                which.append((r, w))
        return which, out

    def measure(self, column: pa.Array) -> np.ndarray:
        """(highest sentence, highest word, log of words over the margin) of each text."""
        out = []
        for lo, hi, words in tx.batches_of_words(column, tx.SPACES, False, tx.SMALL_CHUNK):
            h = words.hashes()
            _, where, back = np.unique(h, return_index=True, return_inverse=True)
            symbols, offsets = word_symbols(words, where)
            value = word_values(symbols, offsets, self.weights)[back]
            single = (np.diff(offsets) == 2)[back]
            for at, word in spelt_out(words, single):
                value[at] = max(value[at], float(word_values(*encode([word]), self.weights).max(initial=0.0)))
            row = words.row
            head = sentences(words)
            found = np.full((hi - lo, 3), LEAST)
            found[:, 2] = 0
            if len(head):
                of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(row))))
                _, once = np.unique(of * len(where) + back, return_index=True)
                np.maximum.at(found[:, 0], row[head], np.bincount(of[once], value[once], len(head)) + self.bias)
                np.maximum.at(found[:, 1], row, value + self.bias)
                found[:, 2] = np.log1p(np.minimum(np.bincount(row[value + self.bias > 0], minlength=hi - lo), MANY))
            found[:, :2] = np.clip(found[:, :2], LEAST, MOST)
            out.append(found)
        return np.vstack(out) if out else np.zeros((0, 3))

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.prior)
        f = (self.measure(column) - self.center) / self.spread
        return 1 / (1 + np.exp(-np.clip(f @ self.logit[:-1] + self.logit[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """`labels` has doc_id and toxic; only its rows are learnt from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known.where("toxic = 1"), "doc_id", toxic_rows).unionByName(sampled(known.where("toxic = 0"), "doc_id", other_rows))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").collect()
    rows.sort(key=lambda r: (r["text"], r["toxic"]))  # the machine does not depend on the order of the table
    return Model([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def _score(model, text_at: int, names: list[str]):
    def scan(batches):
        known: Model = model.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.score(batch.column(text_at)))], names=names)

    return scan


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs` and score (0 to 1). `training` has the texts of the rows of `labels`.
    A column of `docs` named score is replaced."""
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(training, labels))
    tx.release()
    schema = extended(docs.schema, "score double")
    return docs.mapInArrow(tx.released(_score(model, docs.columns.index("text"), schema.names)), schema)
