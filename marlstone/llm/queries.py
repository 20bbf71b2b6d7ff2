"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import more_oracles, oracles
from marlstone.llm.centroids import centroid_clusters
from marlstone.llm.decontaminate import find_contamination
from marlstone.llm.mixing import mix_sources
from marlstone.llm.html import extract_text
from marlstone.llm.infill import infill, restored
from marlstone.llm.katz import score_texts
from marlstone.llm.media import sample_features, text_media
from marlstone.llm.minhash import near_duplicates
from marlstone.llm.quality import select_quality
from marlstone.llm.rules import judge_quality
from marlstone.llm.secrets import count_kind, digest, scan_secrets
from marlstone.llm.shared import store
from marlstone.llm.tokens import count_tokens
from marlstone.llm.warc import archive_pages, page_records


#: A public vocabulary, where no setting spark.marlstone.vocabulary names another file that all executors can open, and the pattern of its pre-tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("first")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The edits are the removals of secrets."""
    vocabulary = vocabulary or spark.conf.get("spark.marlstone.vocabulary", VOCABULARY)
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edits = F.transform("secrets", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), x["kind"], F.lit(" removed]")).alias("new")))
    return count_tokens(found.select("doc_id", "text", edits.alias("edits")), "edits", vocabulary, PATTERN)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store(text_media(table(spark, sf_dir, "documents")), "media")
    return sample_features(media).drop("sniffed")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("secrets")
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    counts = [count_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(spans).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(archive_pages(table(spark, sf_dir, "pages")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).withColumn("posterior", F.round("posterior", 6)).drop("votes")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_media": op4_media,
    "op5_secrets": op5_secrets,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_katz": op8_katz,
    "op9_mix_sources": op9_mix_sources,
    "op10_warc": op10_warc,
    "op11_infill": op11_infill,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = oracles.SQL | more_oracles.SQL

SQL["op9_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/7'), 1, 8) AS BIGINT) AS point
  FROM documents),
s0 AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM s0),
s2 AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lead_rate
  FROM s1 WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(cap, weight * max(lead_rate) OVER ()) AS target FROM s2),
s4 AS (SELECT *, sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM s3),
r AS (
  SELECT rank, (upto - target) / total AS lo,
         CASE WHEN rank = max(rank) OVER () THEN 2.0e0 ELSE upto / total END AS hi
  FROM s4 WHERE target > 0),
slots AS (
  SELECT i, i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0) AS u
  FROM (SELECT CAST(unnest(range((SELECT CAST((sum(size) + 31) // 32 AS BIGINT) FROM d))) AS BIGINT) AS i)),
taken AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY i) - 1 AS block FROM slots JOIN r ON u >= lo AND u < hi),
reach AS (SELECT rank, max(block) + 1 AS n_blocks FROM taken GROUP BY rank),
line AS (
  SELECT d.doc_id, d.size, s4.rank, s4.source_size, s4.target, row_number() OVER () AS id,
    least(coalesce(n_blocks, 0) * 32, 3 * s4.source_size) AS most,
    sum(d.size) OVER (PARTITION BY s4.rank ORDER BY point, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS place
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN reach ON reach.rank = s4.rank)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(size, most - place)) + greatest(0, least(size, most - place - source_size))
    + greatest(0, least(size, most - place - 2 * source_size)) AS BIGINT) AS taken
FROM line
"""
