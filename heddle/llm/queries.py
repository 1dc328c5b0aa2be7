"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import alignment, exact_dedup, html_extract, jaccard_join, mixing, negatives, pieces, pii, pitman_yor, quality, secret_scan, sharding, telephony
from heddle.llm.common import read

#: The folder of public tokenizer files on the driver, and the files that are used.
TOKENIZERS = os.environ.get("HEDDLE_TOKENIZERS", "/opt/tokenizers")
MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def load_pieces(folder: str = TOKENIZERS) -> pieces.Pieces:
    return pieces.Pieces.load(f"{folder}/{MODEL}")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.assign(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_media(read(spark, sf_dir, "documents"), with_media=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), load_pieces(), keep_ids=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
r AS (  -- sources in the order in which they are clamped as the level rises
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE) AS clamped, sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight DESC, source DESC NULLS FIRST) AS open_weight
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (  -- the first source that the level, with all before it clamped, does not clamp
  SELECT arg_min((budget - clamped) / open_weight, 2.0::DOUBLE * source_size / weight) FILTER (WHERE (budget - clamped) / open_weight < 2.0::DOUBLE * source_size / weight) AS level FROM r, b),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, coalesce(least(2.0::DOUBLE * source_size, weight * level), 2.0::DOUBLE * source_size) AS target FROM s, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, CAST(round(q.target) AS BIGINT) - q.whole * q.source_size AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN 2 * (quota - before) > size THEN size ELSE 0 END AS BIGINT) AS taken FROM p
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), label, F.col("embedding"), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
WITH d AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
r AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""


def load_pair(folder: str = TOKENIZERS) -> alignment.Pair:
    return alignment.Pair.load(f"{folder}/{BYTES}", f"{folder}/{MODEL}")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), load_pair())


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.assess(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_media_columns": op7_media_columns,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLES = {"op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL, "op11_hard_negatives": OP11_SQL}
