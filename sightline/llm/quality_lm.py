"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters, of order `ORDER`. The model is trained on all
trusted texts but a fifth, from which the bars are taken. The n-grams of the highest order are
counted exactly, as characters, and summed over the cluster; there are as many as the trusted text
has. All else follows from them by sums and joins on n-grams: lower orders count in how many different
contexts an n-gram stands; the three discounts of each order come from its counts of counts. The table
of all orders stays distributed, and nothing is pruned or hashed together.

A text's perplexity is that of its characters. The table is joined with the texts' distinct n-grams by
shards of texts: each shard asks for its own, they are looked up order by order, and each shard gets
its values back (joined_perplexities). Only while the table has at most `MODEL_ROWS` rows, which is checked
first, tasks hold it whole instead; that saves the exchange of the texts and gives the same values.

A text is kept if its perplexity is within the quantile that its language's trusted texts reach;
languages without trusted texts take that of all. Texts with no characters have no perplexity and are not
kept.

Training needs the trusted rows' texts. Before the join that finds them, a fixed-size bit filter of
their ids lets most of the other texts stay where they are; the join after it is exact.

Defined results: null and empty texts are not kept; rows with a null language are judged by the
quantile over all languages; repeated rows of `trusted` count once; with nothing to train on every
text's perplexity is null and no text is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import extended, materialize, unused

ORDER = 5
#: Bits of a character (or mark) in an n-gram: three characters in a high word, two in a low one.
BITS = np.uint64(21)
CHAR, PAIR = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)
#: Characters that there may be: what is under the lowest order is spread evenly over them.
VOCABULARY = 0x110000
#: Share of a language's trusted texts that is kept.
QUANTILE = 0.995
#: One in so many trusted texts is not trained on; the quantiles come from these, as a model knows its
#: own texts better than others that are as good.
HELD_OUT = 5
#: Probabilities are taken for this at least.
LEAST = 1e-12
#: Rows of a model table (some 100 bytes each where texts are scored) that tasks may hold whole; and bytes of
#: texts that a shard holds where they may not.
MODEL_ROWS = 2_000_000
SHARD_BYTES = 64_000_000
#: Bits of the filter of trusted ids.
FILTER_BITS = 1 << 23


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of the texts, each begun by ORDER - 1 marks."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(2)
    bounds = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    n = len(offsets) - 1
    shifted = bounds + np.arange(n + 1) * (ORDER - 1)
    out = np.ones(shifted[-1], np.uint64)
    inside = np.ones(len(out), bool)
    inside[(shifted[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False
    out[inside] = points
    return out, shifted


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low word of the n-gram of order ORDER that ends at each place (from ORDER - 1 on)."""
    n = len(points) - ORDER + 1
    a, b, c, d, e = (points[i : i + n] for i in range(ORDER))
    return (a << (BITS + BITS)) | (b << BITS) | c, (d << BITS) | e


def ending(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The last n characters of n-grams of at least that order."""
    if n <= 2:
        return np.zeros(len(low), np.uint64), low if n == 2 else low & CHAR
    return high if n == 5 else high & (PAIR if n == 4 else CHAR), low


def hashed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits for an n-gram of any order, never 0."""
    with np.errstate(over="ignore"):
        return np.maximum(tx.mix(tx.mix(high + np.uint64(1)) + low), np.uint64(1))


def summed(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams with the sums of their counts."""
    key = hashed(high, low)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    at = order[first]
    return high[at], low[at], np.add.reduceat(count[order], first) if len(first) else count


def real_places(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the place ORDER - 1 + i is a character, not a mark."""
    real = np.ones(len(points), bool)
    real[(bounds[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False
    return real[ORDER - 1 :]


def _count(batches):
    """(high, low, count) of n-grams of order ORDER, added up by batch."""
    for batch in batches:
        parts = []
        raw, offsets = tx.utf8(batch.column(0))
        for lo, hi in tx.chunks(offsets):
            points, bounds = symbols(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(points) < ORDER:
                continue
            on = real_places(points, bounds)
            high, low = grams(points)
            parts.append(summed(high[on], low[on], np.ones(int(on.sum()), np.int64)))
        if parts:
            high, low, count = summed(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_pydict({"high": tx.signed(high), "low": tx.signed(low), "count": count})


def _ending(n: int, high: str = "high", low: str = "low") -> tuple[str, str]:
    """SQL for the last n characters of an n-gram of at least that order."""
    if n <= 2:
        return "0L", low if n == 2 else f"{low} & {int(CHAR)}L" if n else "0L"
    return {3: f"{high} & {int(CHAR)}L", 4: f"{high} & {int(PAIR)}L", 5: high}[n], low


#: SQL for an n-gram without its last character.
CONTEXT = ("shiftright(high, 21)", f"shiftright(low, 21) | shiftleft(high & {int(CHAR)}L, 21)")


def model_table(counts: DataFrame) -> DataFrame:
    """(n, high, low, alpha, gamma) from the counts of n-grams of order ORDER: alpha is an n-gram's
    discounted share among those with its context, 0 if it was not seen; gamma the weight, after it, of
    the lower order, 1 if nothing follows it. Lower orders count in how many contexts an n-gram stands.
    All sums and joins go by the n-gram."""
    level, shares, weights = counts, {}, {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            high, low = _ending(n)
            level = materialize(level.selectExpr(f"{high} as high", f"{low} as low").groupBy("high", "low").agg(F.count("*").alias("count")), "level")
        size = [0, *level.agg(*[F.count_if(F.col("count") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()]
        y = size[1] / (size[1] + 2 * size[2]) if size[1] else 0.5
        cut = [min(max(k - (k + 1) * y * size[k + 1] / size[k], 0.05), k - 0.05) if size[k] and size[k + 1] else 0.5 for k in (1, 2, 3)]
        told = level.selectExpr("high", "low", "count", f"case count when 1 then {cut[0]!r}D when 2 then {cut[1]!r}D else {cut[2]!r}D end as cut", f"{CONTEXT[0]} as ctx_high", f"{CONTEXT[1]} as ctx_low")
        after = materialize(told.groupBy("ctx_high", "ctx_low").agg(F.sum("count").alias("total"), F.sum("cut").alias("left")), "contexts")
        shares[n] = told.join(after, ["ctx_high", "ctx_low"]).selectExpr("high", "low", "(count - cut) / total as alpha")
        weights[n - 1] = after.selectExpr("ctx_high as high", "ctx_low as low", "left / total as gamma")
    whole = None
    for n in range(ORDER + 1):
        own = weights[0].selectExpr("high", "low", "0D as alpha", "gamma") if not n else shares[n].selectExpr("high", "low", "alpha", "1D as gamma") if n == ORDER else shares[n].join(weights[n], ["high", "low"], "full").selectExpr("high", "low", "coalesce(alpha, 0D) as alpha", "coalesce(gamma, 1D) as gamma")
        own = own.select(F.lit(n).alias("n"), "*")
        whole = own if whole is None else whole.unionByName(own)
    return materialize(whole, "model")


class Model:
    """A model table of bounded size in memory."""

    def __init__(self, high: np.ndarray, low: np.ndarray, alpha: np.ndarray, gamma: np.ndarray):
        self.seen = len(high) > 0
        key = hashed(high, low)
        order = np.argsort(key)
        self.keys, self.alpha, self.gamma = key[order], alpha[order], gamma[order]
        self.table = None

    def __getstate__(self):
        return vars(self) | {"table": None}

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Keys by place, (alpha, gamma) by place, and the shift that gives a key's first place; a key
        stands there or after it, with no empty place between."""
        bits = max(4, (2 * len(self.keys)).bit_length())
        shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, values = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, 2))
        values[:, 1] = 1
        left, at = np.arange(len(self.keys)), (self.keys >> shift).astype(np.int64)
        while len(left):
            free = keys[at] == 0
            keys[at[free]] = self.keys[left[free]]
            mine = keys[at] == self.keys[left]
            values[at[mine], 0], values[at[mine], 1] = self.alpha[left[mine]], self.gamma[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & mask
        return keys, values, shift

    def find(self, key: np.ndarray) -> np.ndarray:
        """(alpha, gamma) of each n-gram; (0, 1) of those that are not known."""
        if self.table is None:
            self.table = self._table()
        keys, values, shift = self.table
        at = (key >> shift).astype(np.int64)
        met = keys[at]
        left = np.flatnonzero((met != key) & (met != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(keys) - 1)
            met = keys[at[left]]
            left = left[(met != key[left]) & (met != 0)]
        return values[at]

    def log_likelihood(self, points: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each place from ORDER - 1 on."""
        high, low = grams(np.concatenate((np.ones(1, np.uint64), points)))  # and the place before
        none = np.zeros(1, np.uint64)
        weight, p = self.find(hashed(none, none))[0, 1], 1 / VOCABULARY
        for n in range(1, ORDER + 1):
            found = self.find(hashed(*ending(high, low, n)))
            p = found[1:, 0] + weight * p
            weight = found[:-1, 1]
        return np.log(np.maximum(p, LEAST))


def perplexities(raw: np.ndarray, offsets: np.ndarray, value_of) -> np.ndarray:
    """Of each text the perplexity of its characters; NaN for none. `value_of` gives the natural log of the
    probability of each place of some symbols, from ORDER - 1 on."""
    out = np.full(len(offsets) - 1, np.nan)
    for lo, hi in tx.chunks(offsets):
        points, bounds = symbols(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.diff(bounds) - (ORDER - 1)
        if len(points) < ORDER or not (n > 0).any():
            continue
        value = np.where(real_places(points, bounds), value_of(points), 0)
        sums = np.concatenate((np.zeros(ORDER), np.cumsum(value, dtype=np.float64)))
        total = sums[bounds[1:]] - sums[np.minimum(bounds[:-1] + ORDER - 1, len(sums) - 1)]
        out[lo:hi] = np.where(n > 0, np.exp(-total / np.maximum(n, 1)), np.nan)
    return out


def _score(model, text_at: int, names: list[str]):
    def scan(batches):
        known: Model = model.value
        for batch in batches:
            out = perplexities(*tx.utf8(batch.column(text_at)), known.log_likelihood)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=names)

    return scan


def _grams_of_shard(table: pa.Table) -> pa.Table:
    """(shard, high, low): the distinct n-grams of a shard's texts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    raw, offsets = tx.utf8(table["text"].combine_chunks())
    for lo, hi in tx.chunks(offsets):
        points, bounds = symbols(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(points) >= ORDER:
            on = real_places(points, bounds)
            high, low = grams(points)
            parts.append(summed(high[on], low[on], np.ones(int(on.sum()), np.int64)))
    high, low, _ = summed(*(np.concatenate(x) for x in zip(*parts)))
    return pa.table({"shard": np.full(len(high), table["shard"][0].as_py(), np.int64), "high": tx.signed(high), "low": tx.signed(low)})


def _score_shard(texts: pa.Table, found: pa.Table) -> pa.Table:
    """(digest, perplexity) of a shard's texts, from the log probabilities of its n-grams."""
    if not texts.num_rows:
        return pa.table({"digest": pa.array([], pa.string()), "perplexity": pa.array([], pa.float64())})
    key = hashed(np.asarray(found["high"]).view(np.uint64), np.asarray(found["low"]).view(np.uint64))
    order = np.argsort(key)
    key, value = key[order], np.asarray(found["value"])[order]

    def value_of(points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, hashed(*grams(points)))
        return value[np.minimum(at, len(key) - 1)]  # places that are no characters are left out after

    out = perplexities(*tx.utf8(texts["text"].combine_chunks()), value_of)
    return pa.table({"digest": texts["digest"].combine_chunks(), "perplexity": pa.array(out, from_pandas=True)})


def joined_perplexities(texts: DataFrame, table: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(digest, perplexity) of distinct texts (digest, text), by joins with a model table of any size.

    Texts are dealt to shards of about `shard_bytes`. A shard gives its distinct n-grams; the distinct
    ones of all shards are looked up order by order, each a join by n-gram; and every shard gets the values
    of its own back."""
    texts = materialize(texts, "texts")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-total // shard_bytes))).cast("long")))
    asked = materialize(texts.groupBy("shard").applyInArrow(_grams_of_shard, "shard long, high long, low long"), "asked")
    wanted = materialize(asked.select("high", "low").distinct(), "wanted")
    p = None
    for n in range(1, ORDER + 1):
        high, low = _ending(n)
        own = wanted.selectExpr(f"{high} as high", f"{low} as low").distinct()
        before, last = _ending(n - 1), table.where(f"n = {n - 1}").selectExpr("high as ctx_high", "low as ctx_low", "gamma")
        own = own.join(table.where(f"n = {n}").select("high", "low", "alpha"), ["high", "low"], "left").selectExpr("*", f"{CONTEXT[0]} as ctx_high", f"{CONTEXT[1]} as ctx_low")
        own = own.join(last, ["ctx_high", "ctx_low"], "left")
        if p is None:
            own = own.withColumn("p", F.lit(1 / VOCABULARY))
        else:
            own = own.selectExpr("*", f"{before[0]} as end_high", f"{before[1]} as end_low").join(p.selectExpr("high as end_high", "low as end_low", "p"), ["end_high", "end_low"])
        p = materialize(own.selectExpr("high", "low", "coalesce(alpha, 0D) + coalesce(gamma, 1D) * p as p"), "probabilities")
    values = asked.join(p, ["high", "low"]).select("shard", "high", "low", F.log(F.greatest("p", F.lit(LEAST))).alias("value"))
    return texts.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_score_shard, "digest string, perplexity double")


def _filter(batches):
    """The bits of the ids met, as one row a task."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = (tx.mix(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    where = np.flatnonzero(bits)
    yield pa.RecordBatch.from_pydict({"byte": where.astype(np.int32), "bits": bits[where].astype(np.int32)})


def _likely(bits):
    def scan(batches):
        known = bits.value
        for batch in batches:
            at = (tx.mix(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            yield batch.filter(pa.array((known[at >> 3] >> (at & 7)) & 1 == 1))

    return scan


def train(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The model table of the texts of all rows of `docs` whose doc_id is in `trusted`."""
    spark = docs.sparkSession
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ids.mapInArrow(_filter, "byte int, bits int").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toPandas().itertuples():
        bits[r.byte] = r.bits
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    likely = texts.mapInArrow(_likely(spark.sparkContext.broadcast(bits)), "doc_id long, text string")
    # Labels grow with the corpus: the same kind of join at every size.
    counted = likely.join(ids.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(_count, "high long, low long, count long")
    return model_table(materialize(counted.groupBy("high", "low").agg(F.sum("count").alias("count")), "counts"))


def in_memory(table: DataFrame) -> Model:
    """A model table, of checked size, on the driver."""
    parts = [(np.zeros(0),) * 4]
    for r in table.select("high", "low", "alpha", "gamma").mapInArrow(_pack, "high binary, low binary, alpha binary, gamma binary").toLocalIterator():
        parts.append(tuple(np.frombuffer(bytes(x), t) for x, t in zip(r, (np.uint64, np.uint64, np.float64, np.float64), strict=True)))
    high, low, alpha, gamma = (np.concatenate(x) if len(parts) > 1 else np.zeros(0) for x in zip(*parts[1:] or parts))
    return Model(high.astype(np.uint64), low.astype(np.uint64), alpha, gamma)


def _pack(batches):
    """Each batch as one row."""
    for batch in batches:
        yield pa.RecordBatch.from_pydict({n: [np.asarray(batch.column(n)).tobytes()] for n in batch.schema.names})


def classify_quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, with_text: bool = True, model_rows: int = MODEL_ROWS) -> DataFrame:
    """All columns of `docs` (doc_id, text, lang) and perplexity, bar and kept. `trusted` has the
    doc_id of trusted rows. Columns of `docs` with these names are replaced. Without `with_text` the
    text is left out, and texts are scored once, not a second time for the result. A model table of at most
    `model_rows` rows goes to the tasks whole; a larger one is joined, with the same result."""
    docs = docs.drop("perplexity", "bar", "kept").withColumn("text", F.col("text").cast("string"))
    lang_key, size, lang_bar, all_bar, digest, found_digest = unused(docs, "lang", "size", "lang_bar", "all_bar", "digest", "found_digest")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD_OUT)) == 0
    table = train(docs, trusted.where(~held_out))
    rows = table.count()
    if not rows:
        scored = docs.withColumn("perplexity", F.lit(None).cast("double"))
    elif rows <= model_rows:
        model = docs.sparkSession.sparkContext.broadcast(in_memory(table))
        schema = extended(docs.schema, "perplexity double")
        scored = docs.mapInArrow(_score(model, docs.columns.index("text"), schema.names), schema)
    else:
        keyed = docs.withColumn(digest, F.md5(F.col("text").cast("binary")))
        distinct = keyed.where(F.length("text") > 0).groupBy(F.col(digest).alias("digest")).agg(F.first("text").alias("text"))
        found = materialize(joined_perplexities(distinct, table), "found").select(F.col("digest").alias(found_digest), "perplexity")
        scored = keyed.join(found, F.col(digest) == F.col(found_digest), "left").drop(digest, found_digest)
    scored = scored.withColumn(size, F.coalesce(F.length("text"), F.lit(0)))
    judged = materialize(scored.drop("text"), "perplexities")
    if not with_text:
        scored = judged
    known = judged.join(trusted.where(held_out).select("doc_id").distinct(), "doc_id", "left_semi").where("perplexity is not null")
    bars = known.rollup("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("bar"), F.grouping("lang").alias("whole"))
    bars = materialize(bars, "bars")
    overall = bars.where("whole = 1").select(F.col("bar").alias(all_bar))
    per_lang = bars.where("whole = 0 and lang is not null").select(F.col("lang").alias(lang_key), F.col("bar").alias(lang_bar))
    # One row, and a row for each language code.
    named = scored.join(per_lang, F.col("lang") == F.col(lang_key), "left").join(F.broadcast(overall), F.lit(True), "left")
    text = F.col(size) > 0
    out = named.withColumn("bar", F.coalesce(lang_bar, all_bar))
    return out.withColumn("kept", text & F.coalesce(F.col("perplexity") <= F.col("bar"), F.lit(True))).drop(lang_key, lang_bar, all_bar, size)
