"""Similarity join on word shingles: Jaccard at or above a threshold, as exact components.

Documents by shingles form a sparse 0/1 matrix; its product with its transpose holds the overlap
of every two documents. The product is taken in blocks, one for each part of a set, and entries
that cannot reach the threshold are discarded from bounds on the sizes of the two sets:

1. Documents with equal sets are one class, known by a hash of the set.
2. Sets that reach the threshold differ in a bounded number d of shingles. The hash range is cut into
   parts, more than d of which hold shingles of a set; so two such sets have the whole content of a part
   in common, and one of the first d + 1 in any order. These contents are the columns. Texts that have a
   passage in common, but not most of their words, seldom agree in all of a part. Sets with too few parts
   meet each other by their first n - ceil(t * n) + 1 shingles in a common order, frequent ones last.
   Only columns in which two classes meet are kept. (Which shingles are frequent only decides what is
   left out of parts and comes last; any choice gives the same links.)
3. Each block first holds every class against its hub, the class with the fewest rare shingles: as
   many candidates as rows. A pair goes on while the sizes, and then bit sketches of the two sets, leave room for the
   overlap that the threshold asks for; then the overlap of the whole sets is counted.
4. Classes that are linked are contracted to components. A block in which few rows are outside the
   component that fills most of it is multiplied out, between rows of different components: at most
   WIDE times as many pairs as rows. What survives the bounds is counted as in 3.
5. A block with more such rows is cut by what its rows have besides a set h: its hub and the frequent
   shingles. If x and y have a shingle in common that h has not, then as many as the threshold asks for
   beyond |x & h| and |y & h|, so one of the first ones of x - h and y - h in a common order. If not, |x & y| is at most |x & h| and |y & h|,
   which bounds the sizes that y and x can have. These shingles and these sizes are the columns of new
   blocks (those of two sizes have two sides). Of the blocks of each hub either the new ones or the old
   ones are multiplied out, whichever makes fewer pairs.

Pairs within a component change nothing, so large groups of near copies never make all their pairs,
while no link between components is lost.

Defined results: texts with fewer than `size` words have the whole sequence as their one shingle;
empty and null texts have none and stand alone; rows with a null doc_id get their n_shingles, link
with nothing and have a null component_id; repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import materialize, unused

SIZE = 4
#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 85
#: Bits of a set's sketch for each of its shingles, at least.
SPARSE = 4
#: Frequent shingles that are told apart in the order: a bounded table, 16 bytes an entry.
FREQUENT = 1 << 16
#: Bits of the filter of documents whose texts are compared.
FILTER_BITS = 1 << 24
#: Sizes at which classes of sizes begin: in each, sets are cut into equally many parts.
LEVELS = 3 ** np.arange(34, dtype=np.int64)
#: Pairs of texts that a task holds the sets of.
PAIRS = 400
#: Rows outside its largest component from which on a block is cut and not multiplied out.
WIDE = 16
#: Sizes at which bands of sizes begin, 256 in each power of two.
BANDS = np.unique(np.ceil(2 ** (np.arange(256 * 40) / 256)).astype(np.int64))


def shingle_sets(words: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, sorted by both, and the rows' first places."""
    h, row, counts = words.hashes(), words.row, words.counts
    whole = tx.grams(h, size)
    at = np.flatnonzero(row[: len(whole)] == row[size - 1 :]) if len(whole) else np.zeros(0, np.int64)
    rows, hashes = [row[at]], [whole[at]]
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            table = h[words.first[few][:, None] + np.arange(n)[None, :]]
            with np.errstate(over="ignore"):
                value = np.full(len(few), n, np.uint64)
                for column in range(n):
                    value = tx.mix(value * tx.WORD_STEP + table[:, column])
            rows.append(few)
            hashes.append(value)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.searchsorted(row, np.arange(len(counts) + 1), "left")


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 where it is empty."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(value), dtype=np.uint64)))
        out = tx.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n > 0, out, np.uint64(0))


def sketches(row: np.ndarray, value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set a bit map with a bit for each shingle by its hash, of at least SPARSE times as
    many bits as shingles, a power of two: a longer one folds onto a shorter one."""
    n = np.diff(first)
    size = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(SPARSE * n, 1))).astype(np.int64) >> 3)
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], np.uint8)
    at = (value & (size[row] * 8 - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, start[row] + (at & (size[row] - 1)), (1 << (at // size[row])).astype(np.uint8))
    flat = out.tobytes()
    return [flat[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def least_differences(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches, lower bounds of how many shingles only the first, and only the second, has."""
    only_x, only_y = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for m, k in np.unique(sizes, axis=0):
        on = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == k))
        a, b = (np.frombuffer(b"".join(s[i] for i in on), np.uint8).reshape(len(on), -1) for s in (x, y))
        a, b = fold(a, min(m, k)), fold(b, min(m, k))
        only_x[on], only_y[on] = np.bitwise_count(a & ~b).sum(1, dtype=np.int64), np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
    return only_x, only_y


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches of `size` bytes: what the same sets give for a smaller power of two. A byte's place
    holds the low bits of the hashes, its bits the three bits above, so bits move as bytes halve."""
    bits = np.unpackbits(sketch, axis=1, bitorder="little").reshape(len(sketch), -1, 8).transpose(0, 2, 1).reshape(len(sketch), -1)
    while bits.shape[1] > 8 * size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return np.packbits(bits.reshape(len(sketch), 8, -1).transpose(0, 2, 1).reshape(len(sketch), -1), axis=1, bitorder="little")


def _measure(size: int):
    """Per document its set's size, signature and sketch; and of each part of a batch, some hundred
    documents, the shingles that stand out as frequent in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "bits", "shingle", "df"]
        for batch in batches:
            for lo, hi, words in tx.batches_of_words(batch.column(1), tx.SPACES, lower=True):
                row, value, first = shingle_sets(words, size)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(tx.signed(signatures(value, first))), pa.array(sketches(row, value, first), pa.binary()), none, none], names=names)
                value, count = np.unique(value, return_counts=True)
                often = count >= max(3, (hi - lo) // 128)
                k = int(often.sum())
                if k:
                    none = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(k, pa.binary()), pa.array(tx.signed(value[often])), pa.array(count[often])], names=names)

    return scan


def block_keys(row: np.ndarray, value: np.ndarray, first: np.ndarray, late: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): keys of which two sets that reach the threshold have one in common.

    The hash range is cut into parts, as many for all sets of a class of sizes, and a key is the whole
    content of a part, leaving out frequent shingles (those with `late` > 0). Sets that reach the threshold
    differ in at most d shingles, so in at most d parts: of more than d parts that are not empty one is
    alike, and one of the first d + 1 in any common order; parts with many shingles come first. A set with
    fewer parts has them all for keys, and its first single shingles, by which it meets its like."""
    n = np.diff(first)
    level = np.searchsorted(LEVELS, n, "right")
    keys, rows = [], []
    short = np.zeros(len(n), bool)
    for step in (0, 1):  # a pair meets in the class of its larger set
        on = n > 0 if step == 0 else 100 * n >= percent * LEVELS[level]
        top = LEVELS[level + step] - 1
        differ = (100 - percent) * (n + np.minimum(100 * n // percent, top)) // (100 + percent)
        parts = 1 + 14 * 2 * (100 - percent) * top // (10 * (100 + percent))
        at = np.flatnonzero(on[row] & (late == 0))
        r, v = row[at], value[at]
        part = ((v >> np.uint64(33)) * parts[r].astype(np.uint64)) >> np.uint64(31)
        starts = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])))) if len(r) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((starts, [len(r)])))
        r = r[starts]
        short |= on & (np.bincount(r, minlength=len(n)) <= differ)
        with np.errstate(over="ignore"):
            key = tx.mix((np.add.reduceat(tx.mix(v), starts) if len(v) else v) + top[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((key, -count, r))
        r, key = r[order], key[order]
        use = np.arange(len(r)) - np.searchsorted(r, r, "left") <= differ[r]
        keys.append(key[use])
        rows.append(r[use])
    at = np.flatnonzero(short[row])
    at = at[np.lexsort((value[at], late[at], row[at]))]
    r = row[at]
    use = np.arange(len(r)) - np.searchsorted(r, r, "left") <= n[r] + (-percent * n[r] // 100)
    keys.append(tx.mix(value[at][use]))
    rows.append(r[use])
    return np.concatenate(keys), np.concatenate(rows)


def lateness(value: np.ndarray, frequent) -> np.ndarray:
    """Of each shingle 0, or its place among the frequent ones, the most frequent last."""
    known, rank = frequent.value
    if not len(known):
        return np.zeros(len(value), np.int64)
    at = np.searchsorted(known, value)
    at[at == len(known)] = 0
    return np.where(known[at] == value, rank[at] + 1, 0)


def hub_order(own: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Orders sets by how many of their shingles are not frequent, then by hash: the smallest of a block
    is the set with least of its own, to which most others of the block are near."""
    return (np.minimum(own, (1 << 22) - 1).astype(np.uint64) << np.uint64(40)) | (sig >> np.uint64(24))


def _blocks(size: int, percent: int, frequent):
    """(token, sig, n, rare): the keys of each set, and its place in the order of hubs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in tx.batches_of_words(batch.column(0), tx.SPACES, lower=True, limit=tx.SMALL_CHUNK):
                row, value, first = shingle_sets(words, size)
                if not len(row):
                    continue
                late = lateness(value, frequent)
                n = np.diff(first)
                sig = signatures(value, first)
                rare = hub_order(np.bincount(row[late == 0], minlength=len(n)), sig)
                key, on = block_keys(row, value, first, late, percent)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key)), pa.array(tx.signed(sig[on])), pa.array(n[on]), pa.array(tx.signed(rare[on]))], names=["token", "sig", "n", "rare"])

    return scan


def _discard(percent: int):
    """Drops pairs whose sketches leave no room for the overlap that is needed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            only_a, only_b = least_differences(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            most = np.minimum(na - only_a, nb - only_b)
            on = pa.array(100 * most >= percent * (na + nb - most))
            yield batch.select(["a", "b", "doc_a", "doc_b"]).filter(on)

    return scan


def _pairs_of_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Bounded parts of rows (a, b, text_a, text_b), and (row, set, set) of those whose texts are of a and b."""
    for batch in (b.slice(lo, PAIRS) for b in batches for lo in range(0, b.num_rows, PAIRS)):
        both = [], []
        for column, out in zip(("text_a", "text_b"), both, strict=True):
            for lo, hi, words in tx.batches_of_words(batch.column(column), tx.SPACES, lower=True, limit=tx.SMALL_CHUNK):
                _, value, first = shingle_sets(words, size)
                sig = tx.signed(signatures(value, first))
                out += [(value[first[i] : first[i + 1]], sig[i]) for i in range(hi - lo)]
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        yield batch, [(i, x, y) for i, ((x, sx), (y, sy)) in enumerate(zip(*both, strict=True)) if sx == a[i] and sy == b[i]]


def _count(size: int, percent: int):
    """Counts the overlap of the whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs_of_sets(batches, size):
            linked = []
            for i, x, y in sets:
                overlap = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * overlap >= percent * (len(x) + len(y) - overlap):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    return scan


def besides(hub: np.ndarray, x: np.ndarray, late: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, pairs of bands, sides) of which two sets of a block that reach the threshold have a shingle
    or a pair in common, whatever the hub and the frequent shingles (those with `late` > 0) are: the first of the
    shingles that x has besides these, and the bands of sizes of x and of sets that reach the threshold with
    x without any of them. The sets of a pair are on sides 1 and 2, and both on 0 if they are of one band."""
    extra = x[~np.isin(x, hub, assume_unique=True) & (late == 0)]
    n, common = len(x), len(x) - len(extra)
    least = -(-percent * n // 100)
    need = max(1, -(-percent * (n + least) // (100 + percent)) - common)
    most = min(100 * n // percent, (100 + percent) * common // percent - n)
    band, low, high = np.searchsorted(BANDS, (n, least, most), "right").tolist()
    other = np.arange(low, high + 1 if least <= most else low)
    pairs = np.minimum(other, band) * len(BANDS) + np.maximum(other, band)
    return extra[: len(extra) - need + 1], pairs.astype(np.uint64), (other > band) + 2 * (other < band)


def _cut(size: int, percent: int, frequent):
    """(token, sig, n, rare, side, origin): the keys that the rows (a, b) of wide blocks, of hub a, have besides the hub."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs_of_sets(batches, size):
            hubs, sigs = (np.asarray(batch.column(c)).view(np.uint64) for c in ("a", "b"))
            for i, hub, x in sets:
                late = lateness(x, frequent)
                shingles, bands, sides = besides(hub, x, late, percent)
                with np.errstate(over="ignore"):
                    salt = tx.mix(hubs[i : i + 1])
                    key = np.concatenate((tx.mix(shingles ^ salt), tx.mix(salt + bands)))
                if len(key):
                    rare = hub_order(np.array([(late == 0).sum()]), sigs[i : i + 1])
                    side = np.concatenate((np.zeros(len(shingles), np.int64), sides))
                    yield pa.RecordBatch.from_arrays([pa.array(tx.signed(c)) for c in (key, np.full(len(key), sigs[i]), np.full(len(key), len(x)), np.full(len(key), rare[0]), side, np.full(len(key), hubs[i]))], names=["token", "sig", "n", "rare", "side", "origin"])

    return scan


def _texts_of(near: DataFrame, texts: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The texts of pairs, found by a bit filter of their documents, so that the others are not exchanged.
    A full filter lets all through and changes no result."""
    place = f"pmod(xxhash64(%s), {filter_bits})"
    bit = "shiftleft(1L, cast({0} % 64 as int))"
    wanted = near.selectExpr("explode(array(doc_a, doc_b)) as doc").selectExpr(f"{place % 'doc'} as at")
    words = wanted.groupBy(F.expr("at div 64").alias("word")).agg(F.expr(f"bit_or({bit.format('at')})").alias("bits"))
    found = F.expr(f"{place % 'doc_id'} div 64 = word and bits & {bit.format(place % 'doc_id')} <> 0")
    return texts.join(F.broadcast(words), found, "left_semi")


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of classes, those that reach the threshold."""
    a = classes.selectExpr("sig as a", "n as n_a", "doc as doc_a", "bits as bits_a")
    b = classes.selectExpr("sig as b", "n as n_b", "doc as doc_b", "bits as bits_b")
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = materialize(near.mapInArrow(tx.released(_discard(percent)), "a long, b long, doc_a long, doc_b long"), "near")
    return materialize(_with_texts(near, texts).mapInArrow(tx.released(_count(size, percent)), "a long, b long"), "links")


def _with_texts(near: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of pairs and their documents."""
    texts = _texts_of(near, texts)
    with_a = near.join(texts.withColumnRenamed("text", "text_a"), near["doc_a"] == texts["doc_id"]).drop("doc_id")
    return with_a.join(texts.withColumnRenamed("text", "text_b"), with_a["doc_b"] == texts["doc_id"]).select("a", "b", "text_a", "text_b")


TOKENS = "token long, sig long, n long, rare long"


def _meeting(tokens: DataFrame) -> DataFrame:
    """(token, sig, n, hub) of the keys in which two classes meet."""
    shared = tokens.groupBy("token").agg(F.min_by("sig", "rare").alias("hub"), F.min("sig").alias("low"), F.max("sig").alias("top")).where("low < top").select("token", "hub")
    # Written first: Spark splits hot keys of a join between two exchanges, not of one on top of a sum.
    shared = materialize(shared, "shared")
    return materialize(tokens.drop("rare").join(shared, "token").distinct(), "blocks")


def _open(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of blocks in which several components meet: their component, the block's largest one, and
    whether more than WIDE rows are outside that."""
    part = blocks.join(roots, blocks["sig"] == roots["node"], "left").selectExpr("token", "sig", "hub", "n", "side", "origin", "coalesce(root, sig) as part")
    part = materialize(part, "parts")
    sizes = part.groupBy("token", "part").agg(F.count("*").alias("rows"), F.max("side").alias("side"))
    main = sizes.groupBy("token").agg(F.sum("rows").alias("all"), F.max("rows").alias("most"), F.max("side").alias("side"), F.max_by("part", F.struct("rows", "part")).alias("main")).where("all > most")
    return materialize(part.join(main.selectExpr("token", "main", f"all - most > {WIDE} and side = 0 as wide"), "token"), "open")


def _work(rows: DataFrame) -> DataFrame:
    """(origin, pairs): how many pairs the blocks of an origin make when they are multiplied out."""
    sums = [F.expr(f"sum(if(side = {k}, 1L, 0L)) as all_{k}") for k in range(3)] + [F.expr(f"sum(if(side = {k} and part <> main, 1L, 0L)) as out_{k}") for k in range(3)]
    blocks = rows.groupBy("token", "origin").agg(*sums)
    return blocks.groupBy("origin").agg(F.expr("sum(out_0 * all_0 + out_1 * all_2 + out_2 * all_1) as pairs"))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of rows of a block that are of different components, and of different sides if it has sides."""
    x = rows.where("part <> main").selectExpr("token", "if(side = 0, 0, 3 - side) as side", "sig as a", "part as part_a", "n as n_a")
    y = rows.selectExpr("token", "side", "sig as b", "part as part_b", "n as n_b", "part <> main as small")
    met = x.join(y, ["token", "side"]).where(f"part_a <> part_b and (not small or a < b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return met.select("a", "b").distinct()


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(docs.mapInArrow(tx.released(_measure(size)), "doc_id long, n long, sig long, bits binary, shingle long, df long"), "sets")
    measured = sets.where("shingle is null").select("doc_id", "n", "sig", "bits")
    # Shingles of one document in a thousand: at most a thousand times as many as a document has.
    total = measured.count()
    often = sets.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") * 1000 >= total).orderBy(F.desc("df"), "shingle").limit(FREQUENT).collect()
    known = np.array([r["shingle"] for r in often], np.int64).view(np.uint64)
    rank = np.arange(len(often))[::-1]
    order = np.argsort(known)
    frequent = docs.sparkSession.sparkContext.broadcast((known[order], rank[order]))

    real = measured.where("doc_id is not null and n > 0")
    classes = materialize(real.groupBy("sig", "n").agg(F.min("doc_id").alias("doc"), F.first("bits").alias("bits")), "classes")
    texts = docs.where("doc_id is not null and text is not null")
    blocks = _meeting(texts.select("text").mapInArrow(tx.released(_blocks(size, percent, frequent)), TOKENS))
    pairs = blocks.where("sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct()
    links = _links(pairs, classes, texts, size, percent)
    roots = materialize(components(links), "roots")

    # Blocks in which several components still meet.
    rows = _open(blocks.selectExpr("*", "0L as side", "hub as origin"), roots).where("sig <> hub")
    met = [_across(rows.where("not wide"), percent)]
    wide = rows.where("wide")
    if not wide.isEmpty():
        docs_of = classes.select("sig", "doc")
        near = wide.select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct().join(docs_of.toDF("a", "doc_a"), "a").join(docs_of.toDF("b", "doc_b"), "b")
        tokens = _with_texts(materialize(near, "wide"), texts).mapInArrow(tx.released(_cut(size, percent, frequent)), f"{TOKENS}, side long, origin long")
        cuts = _open(_meeting(materialize(tokens, "cuts")), roots)
        less = _work(wide).join(_work(cuts).withColumnRenamed("pairs", "left"), "origin", "left").where("coalesce(left, 0) < pairs").select("origin")
        less = materialize(less, "less")
        met += [_across(cuts.join(less, "origin", "left_semi"), percent), _across(wide.join(less, "origin", "left_anti"), percent)]
    more = _links(reduce(DataFrame.unionByName, met).distinct(), classes, texts, size, percent)
    roots = materialize(components(links.unionByName(more)), "roots")

    named = classes.join(roots, classes["sig"] == roots["node"], "left").selectExpr("sig", "n", "doc", "coalesce(root, sig) as root")
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    found = named.join(least, "root").selectExpr("sig as found_sig", "n as found_n", "component_id")
    out = measured.join(found, (measured["sig"] == found["found_sig"]) & (measured["n"] == found["found_n"]), "left")
    return out.selectExpr("doc_id", "n as n_shingles", "if(doc_id is null, null, coalesce(component_id, doc_id)) as component_id")


def drop_near_copies(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` without those whose component has a smaller doc_id; all columns are kept."""
    (copy,) = unused(docs, "copy")
    found = ngram_components(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(copy), "left_anti")
