"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.decontaminate import decontaminate
from sightline.llm.ngram_join import drop_near_copies
from sightline.llm.samples import fold
from sightline.llm.scratch import materialize
from sightline.llm.sentencepiece_codec import encode_decode
from sightline.llm.substring_dedup import substring_dedup
from sightline.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 and more; the scorer learns from the labelled rows of folds 1 to 4."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return score_toxicity(docs, docs, labels).where("score < 0.5").select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: shingles of five words,
    0.8 of them in common. (The values of the query op7_ngram_join hold for that query alone.)"""
    return drop_near_copies(docs, size=5, percent=80).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of passages that a document with a smaller doc_id has; documents of which nothing
    is left go, and texts that lose nothing stay as they are."""
    kept = docs.withColumn("__whole", F.col("text"))
    done = substring_dedup(kept)
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("__whole"))
    gone = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    return _columns(done.where(~gone).withColumn("text", text))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents (two benchmark items or more) and takes the words of single
    whole-window hits out of the others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontaminate(docs, items, excise=True).where(F.size("items") < 2))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of the decoded text."""
    import public_tokenizers

    done = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("substrings", substrings),
    ("benchmark", benchmark),
    ("sentencepiece", sentencepiece),
]

#: Scores and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
