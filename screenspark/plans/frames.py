"""Screening-shaped views of the generic test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.text import folding_tables, stop_words
from screenspark.sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


# ---- process stages -------------------------------------------------------------------

# Every known stage with a capital first letter, and three that are not known.
STAGE_TEXTS = [s.capitalize() for s in fixed.STAGE_OUTCOMES] + [" Aprovado", "Standby", None]


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Events as job-candidate links: job = user, candidate = type and key, stage from the key."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stages = F.array(*[F.lit(s).cast("string") for s in STAGE_TEXTS])
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("codigo_vaga"),
        F.concat_ws("-", "event_type", k).alias("codigo_applicant"),
        F.get(stages, F.pmod(k, F.lit(len(STAGE_TEXTS)))).alias("situacao_candidato"),
        "value",
    )


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SQL_LINKS = f"""links AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS codigo_vaga,
         event_type || '-' || CAST({_K} AS VARCHAR) AS codigo_applicant,
         ({sql_list(STAGE_TEXTS)})[({_K} % {len(STAGE_TEXTS)}) + 1] AS situacao_candidato, value
  FROM events)"""
_PAIRS = ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in fixed.STAGE_OUTCOMES.items())
SQL_OUTCOMES = f"""{SQL_LINKS},
outcomes(stage, outcome) AS (VALUES {_PAIRS}),
labelled AS (
  SELECT l.event_id, l.codigo_vaga, l.codigo_applicant, lower(coalesce(l.situacao_candidato, '')) AS situacao_candidato,
         l.value, coalesce(o.outcome, 'vazio') AS status_simplificado
  FROM links l LEFT JOIN outcomes o ON o.stage = lower(coalesce(l.situacao_candidato, '')))"""


# ---- candidates and jobs --------------------------------------------------------------


def job_count(spark: SparkSession, folder: str) -> Column:
    return table(spark, folder, "benchmark").agg(F.count("*")).scalar()


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document applies to one benchmark item."""
    item = F.pmod(F.col("doc_id"), job_count(spark, folder)).alias("item_id")
    return table(spark, folder, "documents").select("doc_id", item)


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their job's key."""
    item = F.pmod(F.col("doc_id"), job_count(spark, folder)).alias("item_id")
    return table(spark, folder, "documents").withColumn("item_id", item)


SQL_APPLICATIONS = """apps AS (
  SELECT d.*, d.doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents d)"""


def length_score() -> Column:
    """A score from 0 to 1 that grows with a document's length without end, in hundredths."""
    n = F.col("n_chars").cast("double")
    return F.floor(n * 100.0 / (n + 2000.0)) / 100.0


SQL_LENGTH_SCORE = "floor(n_chars::DOUBLE * 100.0::DOUBLE / (n_chars::DOUBLE + 2000.0::DOUBLE)) / 100.0::DOUBLE"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a length score that has many ties."""
    docs = table(spark, folder, "documents").select("doc_id", length_score().alias("score"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return labels.join(docs, "doc_id").withColumn("y_pred", (F.col("score") >= 0.3).cast("int"))


SQL_SCORED = f"""scored AS (
  SELECT l.doc_id, l.quality AS y_true, {SQL_LENGTH_SCORE} AS score,
         CASE WHEN {SQL_LENGTH_SCORE} >= 0.3::DOUBLE THEN 1 ELSE 0 END AS y_pred
  FROM labels l JOIN documents d USING (doc_id))"""


# ---- text -----------------------------------------------------------------------------


def sql_normalized(expr: str) -> str:
    source, target, _ = folding_tables()
    folded = f"regexp_replace(translate(lower({expr}), '{source}', '{target}'), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace({folded}, '[^a-z]+', ' ', 'g'))"


SQL_STOP = "(" + ", ".join(f"'{w}'" for w in stop_words()) + ")"


def sql_tokens(table_sql: str, key: str, text: str, name: str = "tok") -> str:
    """CTE with one row per kept token, numbered in text order."""
    return f"""{name}_all AS (
  SELECT {key}, unnest(string_split({sql_normalized(text)}, ' ')) AS term FROM {table_sql}),
{name} AS (SELECT {key}, term FROM {name}_all WHERE term <> '' AND term NOT IN {SQL_STOP})"""


# ---- drift ----------------------------------------------------------------------------

DRIFT_NUMBERS = [
    "l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_tax",
]
DRIFT_TEXTS = ["l_linestatus", "l_returnflag", "l_shipdate", "p_brand"]
DRIFT_DAY = "1999-01-01"


def drift_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All columns of the line items shipped before and since a day; one column never has a value."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    early = F.col("l_shipdate") < F.lit(DRIFT_DAY).cast("timestamp_ntz")
    sides = lines.drop("p_partkey").withColumn("sem_valor", F.lit(None).cast("string"))
    return sides.filter(early), sides.filter(~early)


SQL_DRIFT_SIDES = f"""sides AS (
  SELECT l.*, p.p_brand, CASE WHEN l_shipdate < TIMESTAMP '{DRIFT_DAY} 00:00:00' THEN 1 ELSE 0 END AS is_ref
  FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey)"""
