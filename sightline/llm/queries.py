"""The queries opN_<name>: each applies one operator, with production parameters, to its whole
table, and derives the columns that are asked for. SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_components

    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"), "agreed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    done = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    done = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", _sha(F.col("text")).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    done = decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return done.select("doc_id", "n_words", "n_hit", n.alias("n_items"), _sha(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import classify_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = classify_quality(docs, _table(spark, sf_dir, "labels").where("quality = 1"), with_text=False)
    return done.select("doc_id", "lang", "perplexity", "bar", "kept")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import fold
    from .toxicity import score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score_toxicity(docs, docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return done.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages
    from .samples import fold

    docs = _table(spark, sf_dir, "documents")
    done = identify_languages(docs.select("doc_id", "text"), docs.where(fold("doc_id", 4) != 2))
    return done.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    done = extract_text(_table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_lm": op6_quality_lm,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
}

OP1_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT DISTINCT a AS vec_id, a AS r FROM links
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.vec_id),
least AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(r, e.vec_id) AS BIGINT) AS component_id,
       coalesce(r, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON e.vec_id = counts.vec_id LEFT JOIN least ON e.vec_id = least.vec_id
"""

OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM split)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
cut AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
  FROM windows JOIN firsts USING (h) WHERE doc_id > least),
numbered AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
kept AS (
  SELECT n.doc_id, string_agg(n.word, ' ' ORDER BY n.i) AS kept
  FROM numbered n LEFT JOIN cut c ON n.doc_id = c.doc_id AND n.i = c.i
  WHERE c.i IS NULL GROUP BY n.doc_id),
gone AS (SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(len(ws), 8) AS n, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes)),
hits AS (SELECT doc_id, x.n, p, item_id FROM doc_windows x JOIN item_windows y ON x.w = y.w AND x.n = y.n),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM split WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS r FROM both_ways
  UNION
  SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.doc_id),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(l.r, d.doc_id) AS BIGINT) AS component_id
FROM split d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_ngram_join": OP7_SQL}
