"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import documents, numbered_rows
from massweave.llm.edit_embedding import edit_fingerprints
from massweave.llm.exact_dedup import exact_groups
from massweave.llm.hard_negatives import hard_negatives
from massweave.llm.lattice_lm import scored
from massweave.llm.license_rules import license_digest
from massweave.llm.mixing import mixture
from massweave.llm.near_dedup import hex_digits, near_components
from massweave.llm.packing import pack_documents
from massweave.llm.periodic_runs import run_digest, with_planted_runs
from massweave.llm.quality import quality_scores
from massweave.llm.quality_rules import quality_rules
from massweave.llm.secret_scan import secret_digest
from massweave.llm.token_counts import token_counts


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_components(numbered_rows(documents(spark, sf_dir)))
    return rows.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(with_planted_runs(documents(spark, sf_dir)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_simhash_near_dedup, op3_edit_fingerprints, op4_token_counts, op5_packing,
        op6_lattice_scores, op7_license_scan, op8_exact_dedup, op9_secret_scan, op10_mixing,
        op11_periodic_runs, op12_hard_negatives, op13_quality_rules,
    )
}

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents
), s AS (
  SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY src_null, src) - 1 AS rank
  FROM d GROUP BY src_null, src
), w AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3 * source_size AS top FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - sum(top) OVER o + top) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM w WINDOW o AS (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT *, least(CAST(top AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), k AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole,
         CASE WHEN rank % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS ramp
  FROM t
), p AS (
  SELECT d.doc_id, d.size, k.*, sum(d.size) OVER (PARTITION BY d.src_null, d.src ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS pre
  FROM d JOIN k ON d.src_null = k.src_null AND d.src = k.src
), q AS (
  SELECT *, greatest(0, least(size, take - whole * source_size - pre)) AS extra FROM p
)
SELECT doc_id, size, source_size, target, CAST(whole * size + extra AS BIGINT) AS taken,
       CASE WHEN size > 0 AND (whole > 0 OR extra > 0) THEN
         ((1 + ramp) - sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * ((pre + (CASE WHEN whole > 0 THEN size ELSE extra END) / 2) / take))) / (2 * ramp)
       END AS position
FROM q
"""

OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM p a JOIN p b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT pos.arid, pos.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY pos.arid, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM pos JOIN s ON s.arid = pos.arid AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

SQL: dict[str, str] = {"op12_hard_negatives": OP12_SQL, "op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL}
