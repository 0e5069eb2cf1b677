"""Tables written and read back, column roles, the text stage, and a join on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.operators import joins, profile, shape
from screenspark.operators.encode import TextConcat
from screenspark.plans import frames
from screenspark.plans.registry import query
from screenspark.session import shared_folder
from screenspark.sources import keyed_json, tables

_DOCUMENTS = "doc_id, lang, n_chars, sha256(text) AS text_sha256"


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("csv_round_trip", f"SELECT {_DOCUMENTS} FROM documents")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with line breaks and quotes through CSV."""
    docs = frames.table(spark, folder, "documents")
    path = shared_folder(spark)
    tables.write_csv(docs, path)
    return _digested(tables.read_table(spark, path, docs.schema))


# Small enough for several ranges a file even on the smallest tables.
RANGE_BYTES = 1 << 16


@query("csv_ranges", f"SELECT {_DOCUMENTS} FROM documents")
def csv_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files with line breaks and quotes inside texts, read by more tasks than there are files."""
    docs = frames.table(spark, folder, "documents")
    path = shared_folder(spark)
    tables.write_csv(docs, path)
    return _digested(tables.read_table(spark, path, docs.schema, split_bytes=RANGE_BYTES))


@query(
    "keyed_json_ranges",
    """SELECT CAST(doc_id AS VARCHAR) AS codigo, lang AS perfil__idioma, n_chars AS perfil__tamanho,
       sha256(text) AS texto_sha256 FROM documents""",
)
def keyed_json_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """One keyed object per file, whole texts among its values, read by more tasks than there are files."""
    docs = frames.table(spark, folder, "documents")
    profile = F.struct(F.col("lang").alias("idioma"), F.col("n_chars").alias("tamanho"))
    record = F.struct(profile.alias("perfil"), F.col("text").alias("texto"))
    path = shared_folder(spark)
    keyed_json.write_documents(docs.select(keyed_json.keyed_document(F.col("doc_id"), record).alias("value")), path)
    kind = T.StructType.fromDDL("perfil STRUCT<idioma: STRING, tamanho: BIGINT>, texto STRING")
    rows = keyed_json.flatten_keyed_json(keyed_json.read_documents(spark, path, split_bytes=RANGE_BYTES), kind, "codigo", sep="__")
    return rows.select("codigo", "perfil__idioma", "perfil__tamanho", F.sha2("texto", 256).alias("texto_sha256"))


@query("parquet_round_trip", f"SELECT {_DOCUMENTS} FROM documents")
def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}.parquet"
    tables.write_parquet(frames.table(spark, folder, "documents"), path)
    return _digested(tables.read_table(spark, path))


@query("json_round_trip", f"SELECT {_DOCUMENTS} FROM documents")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    tables.write_json(frames.table(spark, folder, "documents"), path, keep_nulls=True)
    return _digested(tables.read_json_table(spark, path, lines=True))


FEATURE_MAP = {
    "id": ["o_orderkey"],
    "date": ["o_orderdate"],
    "group": ["o_custkey", "absent"],
    "text": ["o_orderpriority"],
    "vaga_info": ["o_orderstatus"],
    "target": ["status_simplificado"],
}


_ROLE_ROWS = [
    ("by_role", "numbers", "o_totalprice"),
    ("by_role", "categories", "o_orderstatus"),
    ("by_role", "texts", "o_orderpriority"),
    ("by_role", "excluded", "o_custkey"),
    ("by_role", "excluded", "o_orderdate"),
    ("by_role", "excluded", "o_orderkey"),
    ("by_role", "excluded", "status_simplificado"),
    ("by_type", "numbers", "o_totalprice"),
    ("by_type", "categories", "o_orderstatus"),
    ("by_type", "categories", "status_simplificado"),
    ("by_type", "texts", "o_orderpriority"),
    ("group", "present", "o_custkey"),
    ("target", "chosen", "status_simplificado"),
    ("fields", "job", "o_orderpriority"),
    ("fields", "candidate", "o_orderstatus"),
]
_ROLE_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "status_simplificado")
_ROLE_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, (count(*) - count({c})) / count(*)::DOUBLE AS missing_rate, count(DISTINCT {c}) AS n_distinct FROM o"
    for c in _ROLE_COLUMNS
)


@query(
    "column_roles",
    f"""WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN 'contratado' END AS status_simplificado FROM orders),
    p AS ({_ROLE_PROFILE}),
    v(part, kind, feature) AS (VALUES {", ".join(map(str, _ROLE_ROWS))})
    SELECT part, kind, feature, n_rows, missing_rate, n_distinct FROM v JOIN p USING (feature)""",
)
def column_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of ``orders`` under its roles, profiled over the whole table: rows, missing values, distinct values."""
    status = F.when(F.col("o_orderstatus") != "P", "contratado")
    orders = frames.table(spark, folder, "orders").withColumn("status_simplificado", status)
    by_role, by_type = shape.classify_features(orders, FEATURE_MAP), shape.classify_by_type(orders, FEATURE_MAP)
    groups, target = shape.groups_and_target(orders.columns, FEATURE_MAP)
    meta = {"schema_in": {"cat": by_role.categories, "txt": [f"perfil_vaga.{t}" for t in by_role.texts]}}
    job, candidate = shape.job_and_candidate_fields(meta)
    kinds = ("numbers", "categories", "texts", "excluded", "unmapped")
    found = [("by_role", k, c) for k in kinds for c in getattr(by_role, k)]
    found += [("by_type", k, c) for k in kinds[:3] for c in getattr(by_type, k)]
    found += [("group", "present", g) for g in groups] + [("target", "chosen", target)]
    found += [("fields", "job", c.removeprefix("perfil_vaga.")) for c in job] + [("fields", "candidate", c) for c in candidate]
    profiled = profile.missing_and_cardinality(orders)
    every = orders.agg(F.count("*")).scalar()
    roles = [F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("part", "kind", "role_of")))) for row in found]
    return (
        profiled.select("*", F.explode(F.array(*roles)).alias("r"))
        .filter(F.col("r.role_of") == F.col("feature"))
        .select("r.part", "r.kind", "feature", every.alias("n_rows"), "missing_rate", F.col("nunique").alias("n_distinct"))
    )


@query(
    "text_concat_stage",
    "SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(text, '')) AS joined_sha256 FROM documents",
)
def text_concat_stage(spark: SparkSession, folder: str) -> DataFrame:
    """The fitted stage ignores the column that the table does not have."""
    docs = frames.table(spark, folder, "documents")
    stage = TextConcat(inputCols=["lang", "absent", "text"], outputCol="joined", sep="|").fit(docs)
    return stage.transform(docs).select("doc_id", F.sha2("joined", 256).alias("joined_sha256"))


@query(
    "hot_job_join",
    """WITH jobs AS (SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1)
    SELECT event_id, event_type, n, round(value / top, 9) AS share FROM events JOIN jobs USING (event_type)""",
)
def hot_job_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its type's totals: a few keys hold all rows, and the join deals each of them out."""
    events = frames.table(spark, folder, "events")
    jobs = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    joined = joins.skew_join(events, jobs, "event_type", "inner")
    return joined.select("event_id", "event_type", "n", F.round(F.col("value") / F.col("top"), 9).alias("share"))
