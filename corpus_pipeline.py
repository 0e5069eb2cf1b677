"""From raw documents to token ids: five stages, each written and read again.

1. Language ID learns from the labelled rows and drops texts without a letter and
   texts whose letter trigrams the labelled rows do not know.
2. Line dedup cuts later copies of repeated line runs; emptied documents stay.
3. SimHash near-dedup keeps the document with the smallest id of each group.
4. Mixing repeats or leaves out documents until every source has its share.
5. SentencePiece turns every text into sampled piece ids.

Every stage reads and writes all columns of ``documents`` but the last, which
returns ``doc_id, source, ids, n_pieces``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm import language_id, line_dedup, mixing, pieces, simhash
from screenspark.llm.common import written
from screenspark.names import free_name
from screenspark.plans.frames import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_known_languages(docs, ~language_id.held_out(F.col("doc_id")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated_lines(docs, result=free_name(docs, "removed_lines"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs, keep=["source"])
    return found.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"))


STAGES = [
    ("language", language),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("token ids", token_ids),
]
# Learned languages, fingerprints and sampled pieces cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
