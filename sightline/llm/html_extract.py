"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks, the stretches of text between the edges of block elements. A
bidirectional LSTM in NumPy reads each page's whole sequence of blocks; a block's vector holds its
tag path (elements, classes and ids), all its hashed words, and its length, links and place. Each block
is labelled from both directions, so from the whole page. The network is trained once on made-up
pages (page_generator) by `python -m sightline.llm.html_extract`; it has no other source and a fixed
size, and its weights follow from the seed.

Defined results: null and empty pages, and pages without a block taken for main text, have an empty
text. Broken markup is read as far as it goes: unclosed elements end with what encloses them, a `<`
that begins no tag is text, a tag that is never closed is dropped. Scripts, styles and other raw
elements end at their own end tag alone, and with the page if there is none. Pages of any length are
read whole, in time that follows their length. Rows are worked on one by one.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .page_generator import pages as made_pages
from .scratch import extended

#: Pages to train on, and units of each direction.
TRAIN_PAGES, EPOCHS, UNITS, SEED = 2500, 9, 24, 3
WORD_SLOTS = 48
#: What `python -m sightline.llm.html_extract` writes: the weights that follow from the constants above.
WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Blocks whose vectors are made at a time.
PART_BLOCKS = 20_000
#: Bytes of pages that are read side by side; a longer page is read alone.
PART_BYTES = 4_000_000

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style title textarea template noscript iframe svg select button object math".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: What the start of an element ends, if it is open within the element named last.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "tr": ("tr", ("table",)), "dd": ("dt", ("dl",)), "dt": ("dd", ("dl",)), "option": ("option", ("select",))}
CELLS, TERMS = {"td", "th"}, {"dd", "dt"}
#: Elements that keep what stands around them open.
FENCES = frozenset("table div article section body td button".split())
ENDS_P = BLOCKS - {"br", "body", "html", "head", "caption", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A tag after its `<`: slash, name, attributes. Quotes only count after an equals sign, and an open one
#: that is never closed counts as a character. Possessive throughout, so a tag is read once.
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
LOOSE_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
STARTS_TAG = re.compile(r"/?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")


def lexed(page: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("", tag, attributes) and ("/", tag, attributes) in page order.

    The content of raw elements is passed over up to their own end tag, whatever it looks like; without
    one it is the rest of the page. Comments and declarations are left out. Every character is looked
    at a bounded number of times: once a tag turns out to swallow the rest of the page, because quotes
    do not pair up, the tags after it end at their first `>`.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            yield "", "", page[at:lt]
        if STARTS_TAG.match(page, lt + 1):
            if lt > last:  # a tag that is never closed: what would stand in it is dropped
                at = page.find("<", lt + 1)
                if at < 0:
                    return
                continue
            m = TAG.match(page, lt + 1) if quotes else None
            if m is None:
                quotes = False
                m = LOOSE_TAG.match(page, lt + 1)
            slash, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
            yield slash, tag, attributes
            at = m.end()
            if not slash and tag in RAW and not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                if end is None:
                    return
                at = end.start()
        elif page.startswith("<!--", lt):
            end = COMMENT_END.search(page, lt + 2)
            if end is None:
                return
            at = end.end()
        elif page[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 2 < len(page):
            if lt > last:
                return
            at = page.find(">", lt + 2) + 1
        else:
            yield "", "", "<"
            at = lt + 1
    if at < len(page):
        yield "", "", page[at:]


class Open:
    """The open elements, with where each kind of them stands and which marks hold inside them."""

    def __init__(self, known):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.marks: dict[str, int] = {}
        self.links = self.hidden = 0

    def push(self, tag: str, attributes: str) -> None:
        names = ["tag:" + tag]
        for a, b, c in NAMED.findall(attributes) if attributes else ():
            names += ["name:" + p for p in PART.findall((a or b or c).lower())]
        own = tuple(names if self.known is None else [n for n in names if n in self.known])
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, own))
        for n in own:
            self.marks[n] = self.marks.get(n, 0) + 1
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, own = self.stack.pop()
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            for n in own:
                self.marks[n] -= 1
                if not self.marks[n]:
                    del self.marks[n]
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN

    def innermost(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def end_before(self, tag: str) -> None:
        """Ends what the start of `tag` ends: paragraphs, and items of its own kind."""
        want, stops = ENDS.get(tag, ("", ()))
        ended = {"p", want} | (CELLS if tag in CELLS else TERMS if tag in TERMS else set())
        stop = self.innermost((set(stops) | FENCES) - ended)
        stop = max(stop, self.innermost([want]) - 1)
        first = [p[k] for t in ended if (p := self.at.get(t)) and (k := bisect_right(p, stop)) < len(p)]
        if first:
            self.pop_to(min(first))


def leaf_blocks(page: str, known=None) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(path marks, text, characters in links, depth) of each block with text, in page order. With
    `known`, only marks in it; a block then costs no more than those, however deep it stands."""
    found: list[tuple[tuple[str, ...], str, int, int]] = []
    parts: list[str] = []
    elements = Open(known)
    path: tuple[tuple[str, ...], int] = ((), 0)
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((path[0], text, linked, path[1]))
            parts.clear()
        linked = 0

    for slash, tag, rest in lexed(page):
        if not tag:
            if not elements.hidden:
                text = html.unescape(rest) if "&" in rest else rest
                if not parts:
                    if not text or text.isspace():
                        continue
                    depth = len(elements.stack)
                    path = ((*elements.marks, *(["leaf:" + elements.stack[-1][0]] if depth else [])), depth)
                parts.append(text)
                if elements.links:
                    linked += len(text)
            continue
        block = tag in BLOCKS
        if slash:
            where = elements.at.get(tag)
            if block:
                flush()
            if where and (block or not elements.blocks or elements.blocks[-1] < where[-1]):
                elements.pop_to(where[-1])  # an inline element does not end blocks within it
            continue
        if block:
            flush()
        if tag in ENDS_P or tag in ENDS:
            elements.end_before(tag)
        if tag in VOID or rest.endswith("/") and not block:
            continue
        elements.push(tag, rest)
    flush()
    return found


class Reader:
    """Turns pages into vectors: one row for each block."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens = tokens
        self.width = len(tokens) + WORD_SLOTS + 9
        self.slots: dict[str, int] = {}

    def vectors(self, pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, first row of each page)."""
        first = np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int64)
        return self.rows([(b, k, len(p)) for p in pages for k, b in enumerate(p)]), first

    def rows(self, blocks: list[tuple]) -> np.ndarray:
        """A row for each (block, place in its page, blocks of its page)."""
        out = np.zeros((len(blocks), self.width), np.float32)
        known, base = self.tokens, len(self.tokens)
        rows, cols = [], []
        numbers = np.zeros((len(blocks), 9), np.float32)
        slot = self.slots
        for at, ((path, text, linked, depth), k, n) in enumerate(blocks):
            for t in path:
                c = known.get(t)
                if c is not None:
                    rows.append(at)
                    cols.append(c)
            words = text.lower().split(" ")
            mine = []
            for w in words:
                s = slot.get(w)
                if s is None:
                    if len(slot) > 200_000:
                        slot.clear()
                    s = slot[w] = zlib.crc32(w.encode()) % WORD_SLOTS
                mine.append(s)
            out[at, base : base + WORD_SLOTS] = np.bincount(mine, minlength=WORD_SLOTS) / len(words) ** 0.5
            size = len(text)
            numbers[at] = (np.log1p(size) / 5, min(1.0, linked / size), len(words) < 4, text[-1] in ".!?", min(depth, 12) / 12, k / n, 1 - k / n, k == 0, np.log1p(n) / 5)
        out[rows, cols] = 1
        out[:, base + WORD_SLOTS :] = numbers
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Layout:
    """Rows of pages of different lengths in order of steps, the longest page first."""

    def __init__(self, first: np.ndarray, backward: bool):
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        lengths = counts[order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
        self.before = np.concatenate(([0], np.cumsum(self.active)))
        page = np.arange(self.before[-1]) - np.repeat(self.before[:-1], self.active)
        step = np.repeat(np.arange(steps), self.active)
        self.at = (first[1:][order][page] - 1 - step) if backward else (first[:-1][order][page] + step)


class Lstm:
    """One direction, with forget gates open at the start."""

    def __init__(self, width: int, units: int, rng: np.random.Generator):
        self.units = units
        self.p = {"wx": rng.normal(0, 0.15, (width, 4 * units)).astype(np.float32), "wh": rng.normal(0, 0.2, (units, 4 * units)).astype(np.float32), "b": np.zeros(4 * units, np.float32)}
        self.p["b"][units : 2 * units] = 1

    @classmethod
    def holding(cls, p: dict[str, np.ndarray]) -> Lstm:
        self = cls.__new__(cls)
        self.p, self.units = p, len(p["wh"])
        return self

    def run(self, gates: np.ndarray, layout: Layout, keep: bool = False):
        """Hidden states by row, from what the rows give to the gates; with `keep`, also what the
        backward pass needs."""
        u = self.units
        gates = gates[layout.at]
        n = layout.active[0] if len(layout.active) else 0
        h, c = np.zeros((n, u), np.float32), np.zeros((n, u), np.float32)
        hs, cs = np.zeros((len(gates), u), np.float32), np.zeros((len(gates), u), np.float32)
        for t, k in enumerate(layout.active):
            a = layout.before[t]
            z = gates[a : a + k] + h[:k] @ self.p["wh"]
            open_ = sigmoid(z[:, : 3 * u])
            i, f, o = open_[:, :u], open_[:, u : 2 * u], open_[:, 2 * u :]
            g = np.tanh(z[:, 3 * u :])
            c = f * c[:k] + i * g
            h = o * np.tanh(c)
            hs[a : a + k], cs[a : a + k] = h, c
            if keep:
                gates[a : a + k] = np.hstack([i, f, o, g])
        out = np.zeros_like(hs)
        out[layout.at] = hs
        return (out, (gates, hs, cs)) if keep else out

    def back(self, x: np.ndarray, layout: Layout, kept, grad: np.ndarray) -> dict[str, np.ndarray]:
        u = self.units
        gates, hs, cs = kept
        grad = grad[layout.at]
        n = layout.active[0] if len(layout.active) else 0
        dh, dc = np.zeros((n, u), np.float32), np.zeros((n, u), np.float32)
        dz = np.zeros_like(gates)
        dwh = np.zeros_like(self.p["wh"])
        for t in range(len(layout.active) - 1, -1, -1):
            k, a = layout.active[t], layout.before[t]
            i, f, o, g = (gates[a : a + k, j * u : (j + 1) * u] for j in range(4))
            tc = np.tanh(cs[a : a + k])
            d = grad[a : a + k] + dh[:k]
            e = dc[:k] + d * o * (1 - tc**2)
            if t:
                b = layout.before[t - 1]
                c0, h0 = cs[b : b + k], hs[b : b + k]
            else:
                c0 = h0 = np.zeros((k, u), np.float32)
            z = np.hstack([e * g * i * (1 - i), e * c0 * f * (1 - f), d * tc * o * (1 - o), e * i * (1 - g**2)])
            dz[a : a + k] = z
            dwh += h0.T @ z
            dh[:k], dc[:k] = z @ self.p["wh"].T, e * f
        flat = np.zeros_like(dz)
        flat[layout.at] = dz
        return {"wx": x.T @ flat, "wh": dwh, "b": dz.sum(0)}


def placed_labels(blocks: list, labels: list[tuple[str, int]]) -> np.ndarray:
    """The label of each block: of the next label in page order with its text, so a text that stands in
    two places has a label for each."""
    out, at = np.zeros(len(blocks), np.float32), 0
    for i, (_, text, _, _) in enumerate(blocks):
        k = next((k for k in range(at, len(labels)) if labels[k][0] == text), None)
        if k is not None:
            out[i], at = labels[k][1], k + 1
    return out


class Labeller:
    """Both directions and the output unit, trained on made-up pages."""

    def __init__(self, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        data = []
        tokens: dict[str, int] = {}
        for page, labels in made_pages(train_pages):
            blocks = leaf_blocks(page)
            data.append((blocks, placed_labels(blocks, labels)))
            for path, *_ in blocks:
                for t in path:
                    tokens.setdefault(t, len(tokens))
        self.reader = Reader(tokens)
        self.ways = [Lstm(self.reader.width, units, rng), Lstm(self.reader.width, units, rng)]
        self.out = {"w": rng.normal(0, 0.2, 2 * units).astype(np.float32), "b": np.zeros(1, np.float32)}
        params = [*((m.p, k) for m in self.ways for k in m.p), *((self.out, k) for k in self.out)]
        mean = {(id(p), k): np.zeros_like(p[k]) for p, k in params}
        square = {(id(p), k): np.zeros_like(p[k]) for p, k in params}
        step = 0
        ready = []
        for lo in range(0, len(data), 30):
            part = [d for d in data[lo : lo + 30] if len(d[0])]
            x, first = self.reader.vectors([b for b, _ in part])
            ready.append((x, first, np.concatenate([y for _, y in part])))
        for epoch in range(epochs):
            for k in rng.permutation(len(ready)):
                x, first, y = ready[k]
                x = x * (rng.random(x.shape) > 0.1)  # no single mark may decide alone
                layouts = [Layout(first, False), Layout(first, True)]
                states, kept = zip(*(m.run(x @ m.p["wx"] + m.p["b"], l, True) for m, l in zip(self.ways, layouts)))
                h = np.hstack(states)
                d = (sigmoid(h @ self.out["w"] + self.out["b"]) - y) / len(y)
                grads = [m.back(x, l, s, np.outer(d, self.out["w"][i * units : (i + 1) * units]).astype(np.float32)) for i, (m, l, s) in enumerate(zip(self.ways, layouts, kept))]
                every = [*((m.p, k, g[k]) for m, g in zip(self.ways, grads) for k in g), (self.out, "w", h.T @ d), (self.out, "b", np.array([d.sum()], np.float32))]
                step += 1
                rate = 0.02 * (0.5 ** (epoch / 3))
                for p, name, g in every:
                    key = (id(p), name)
                    mean[key] = 0.9 * mean[key] + 0.1 * g
                    square[key] = 0.99 * square[key] + 0.01 * g * g
                    p[name] -= (rate * (mean[key] / (1 - 0.9**step)) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        del data, ready

    def save(self, path: Path) -> None:
        arrays = {f"way{i}_{k}": v for i, m in enumerate(self.ways) for k, v in m.p.items()} | {f"out_{k}": v for k, v in self.out.items()}
        np.savez(path, tokens=np.array(json.dumps(list(self.reader.tokens))), **arrays)

    @classmethod
    def load(cls, path: Path) -> Labeller:
        self = cls.__new__(cls)
        with np.load(path) as kept:
            self.reader = Reader({t: i for i, t in enumerate(json.loads(str(kept["tokens"])))})
            self.ways = [Lstm.holding({k: kept[f"way{i}_{k}"] for k in ("wx", "wh", "b")}) for i in range(2)]
            self.out = {k: kept[f"out_{k}"] for k in ("w", "b")}
        return self

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Share of certainty that each block is main text. Vectors are made for some blocks at a time;
        of a page's blocks all are held as gates alone."""
        first = np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int64)
        gates = [np.zeros((first[-1], 4 * m.units), np.float32) for m in self.ways]
        blocks = [(b, k, len(p)) for p in pages for k, b in enumerate(p)]
        for lo in range(0, len(blocks), PART_BLOCKS):
            x = self.reader.rows(blocks[lo : lo + PART_BLOCKS])
            for g, m in zip(gates, self.ways, strict=True):
                g[lo : lo + PART_BLOCKS] = x @ m.p["wx"] + m.p["b"]
        if not blocks:
            return [np.zeros(0) for _ in pages]
        h = np.hstack([m.run(g, Layout(first, back)) for g, m, back in zip(gates, self.ways, (False, True), strict=True)])
        p = sigmoid(h @ self.out["w"] + self.out["b"])
        return [p[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def texts(self, pages: list[str | None]) -> list[str]:
        known = self.reader.tokens
        blocks = [leaf_blocks(p or "", known) for p in pages]
        return [" ".join(b[1] for b, p in zip(own, ps, strict=True) if p >= 0.5) for own, ps in zip(blocks, self.label(blocks), strict=True)]


@cache
def trained() -> Labeller:
    """The labeller as trained once by `python -m sightline.llm.html_extract`, with this module's constants."""
    return Labeller.load(WEIGHTS)


def _extract(model, html_at: int, names: list[str]):
    def scan(batches):
        known: Labeller = model.value
        for whole in batches:
            _, offsets = tx.utf8(whole.column(html_at))
            for lo, hi in tx.chunks(offsets, PART_BYTES):
                batch = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.texts(batch.column(html_at).to_pylist()), pa.string())], names=names)

    return scan


def extract_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """All columns of `pages` (with html) and text. A column of `pages` named text is replaced."""
    pages = pages.drop("text").withColumn("html", F.col("html").cast("string"))
    model = pages.sparkSession.sparkContext.broadcast(labeller or trained())
    schema = extended(pages.schema, "text string")
    return pages.mapInArrow(_extract(model, pages.columns.index("html"), schema.names), schema)


if __name__ == "__main__":
    Labeller().save(WEIGHTS)
