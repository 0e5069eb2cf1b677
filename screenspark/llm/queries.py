"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm import (
    edit_fingerprint,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    ngram_lm,
    pieces,
    quality,
    ranked_search,
    resampling,
    simhash,
    substring_dedup,
    warc,
)
from screenspark.llm.common import written
from screenspark.plans.frames import table
from screenspark.plans.registry import query


@query("op4_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scores = ngram_lm.score_documents(docs, ~ngram_lm.held_out(F.col("doc_id")))
    return scores.withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))


@query("op5_substring_dedup", substring_dedup.SQL)
def substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeated_windows(table(spark, folder, "documents")))


@query("op7_source_mixing", mixing.SQL)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_exact_dedup",
    r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="largest")


@query("op6_simhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op8_language_id")
def language(spark: SparkSession, folder: str) -> DataFrame:
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.identify(table(spark, folder, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_edit_fingerprint")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(edit_fingerprint.fingerprint_documents(table(spark, folder, "documents")))
    return edit_fingerprint.with_groups(rows)


@query("op1_line_dedup", line_dedup.SQL)
def lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    docs = docs.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    kept = line_dedup.remove_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op3_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to FROM b""",
)
def archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_importance_resampling")
def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@query("op11_ranked_search", ranked_search.SQL)
def ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
