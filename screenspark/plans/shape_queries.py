"""Sources, joins, labels, filters and schema shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.functions import scalars
from screenspark.names import col
from screenspark.operators import joins, profile, shape
from screenspark.plans import frames
from screenspark.plans.registry import query
from screenspark.session import parallelism, shared_folder
from screenspark.sources.keyed_json import flatten_keyed_json, keyed_document, load_prospects
from screenspark.sources.tables import json_rows, write_bucketed

ORDER_RECORD = T.StructType(
    [
        T.StructField("titulo", T.StringType()),
        T.StructField("valor", T.DoubleType()),
        T.StructField(
            "informacoes",
            T.StructType(
                [
                    T.StructField("situacao", T.StringType()),
                    T.StructField("cliente", T.StructType([T.StructField("codigo", T.LongType())])),
                    T.StructField("vazio", T.StringType()),
                ]
            ),
        ),
    ]
)


@query(
    "keyed_json_flatten",
    """SELECT CAST(o_orderkey AS VARCHAR) AS codigo_vaga, o_orderpriority AS titulo, o_totalprice AS valor,
       o_orderstatus AS informacoes__situacao, o_custkey AS informacoes__cliente__codigo,
       CAST(NULL AS VARCHAR) AS informacoes__vazio FROM orders""",
)
def keyed_json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    record = F.struct(
        F.col("o_orderpriority").alias("titulo"),
        F.col("o_totalprice").alias("valor"),
        F.struct(
            F.col("o_orderstatus").alias("situacao"),
            F.struct(F.col("o_custkey").alias("codigo")).alias("cliente"),
            F.lit(None).cast("string").alias("vazio"),
        ).alias("informacoes"),
    )
    documents = frames.table(spark, folder, "orders").select(
        keyed_document(F.col("o_orderkey"), record).alias("value")
    )
    return flatten_keyed_json(documents, ORDER_RECORD, "codigo_vaga", sep="__")


@query(
    "prospects_explode",
    """WITH lines AS (
      SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS codigo_vaga, source AS titulo_vaga, lang AS modalidade,
       md5(line) AS codigo_applicant, line AS nome_candidato, lang AS situacao_candidato,
       CAST(NULL AS VARCHAR) AS data_candidatura, CAST(NULL AS VARCHAR) AS ultima_atualizacao,
       CAST(NULL AS VARCHAR) AS comentario, CAST(NULL AS VARCHAR) AS recrutador
    FROM lines WHERE line <> ''""",
)
def prospects_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document that is not empty is a prospect; an empty document has none."""
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    prospects = F.transform(
        lines,
        lambda line: F.struct(
            F.md5(line.cast("binary")).alias("codigo"),
            line.alias("nome"),
            F.col("lang").alias("situacao_candidado"),
        ),
    )
    record = F.struct(
        F.col("source").alias("titulo"), F.col("lang").alias("modalidade"), prospects.alias("prospects")
    )
    documents = frames.table(spark, folder, "documents").select(
        keyed_document(F.col("doc_id"), record).alias("value")
    )
    return load_prospects(documents)


@query(
    "json_rows",
    """SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority,
       'o_totalprice': o_totalprice}) AS VARCHAR) AS value FROM orders""",
)
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    orders = frames.table(spark, folder, "orders")
    return json_rows(orders.select("o_orderkey", "o_orderpriority", "o_totalprice"))


def screening_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as jobs, their lines as prospects, parts as applicants."""
    jobs = frames.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("codigo_vaga"),
        F.col("o_orderpriority").alias("titulo"),
        F.col("o_orderstatus").alias("modalidade"),
    )
    prospects = frames.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("codigo_vaga"),
        F.concat(F.lit("linha "), F.col("l_linenumber").cast("string")).alias("titulo_vaga"),
        F.col("l_linestatus").alias("modalidade"),
        F.col("l_partkey").cast("string").alias("codigo_applicant"),
        F.col("l_returnflag").alias("situacao_candidato"),
    )
    applicants = frames.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("codigo_applicant"),
        F.col("p_name").alias("nome"),
        F.col("p_type").alias("modalidade"),
    )
    return jobs, prospects, applicants


@query(
    "jobs_prospects_applicants",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS codigo_vaga, o.o_orderstatus AS modalidade,
       'linha ' || CAST(l.l_linenumber AS VARCHAR) AS titulo, CAST(l.l_partkey AS VARCHAR) AS codigo_applicant,
       l.l_returnflag AS situacao_candidato, p.p_name AS nome, p.p_type AS modalidade_applicant
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    LEFT JOIN part p ON p.p_partkey = l.l_partkey""",
)
def jobs_prospects_applicants(spark: SparkSession, folder: str) -> DataFrame:
    return joins.join_screening_tables(*screening_sources(spark, folder))


@query(
    "bucketed_join",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS codigo_vaga, o.o_orderpriority AS titulo,
       CAST(l.l_partkey AS VARCHAR) AS codigo_applicant, l.l_returnflag AS situacao_candidato
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
)
def bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs and prospects written once in buckets of the job key, joined without a shuffle."""
    jobs, prospects, _ = screening_sources(spark, folder)
    buckets = parallelism(spark)

    def stored(df: DataFrame) -> DataFrame:
        path = shared_folder(spark)
        return write_bucketed(df, f"bucketed_{path.rsplit('/', 1)[1]}", "codigo_vaga", buckets, path)

    both = stored(jobs).join(stored(prospects).drop("modalidade").hint("merge"), "codigo_vaga", "left")
    return both.select("codigo_vaga", "titulo", "codigo_applicant", "situacao_candidato")


@query(
    "status_map",
    f"WITH {frames.SQL_OUTCOMES} SELECT event_id, situacao_candidato, status_simplificado FROM labelled",
)
def status_map(spark: SparkSession, folder: str) -> DataFrame:
    labelled = shape.with_outcome(frames.links(spark, folder))
    return labelled.select("event_id", "situacao_candidato", "status_simplificado")


SQL_SCREENING = f"""{frames.SQL_OUTCOMES}, screening AS (
  SELECT *, CASE WHEN status_simplificado IN ('contratado', 'em_processo') THEN 1 ELSE 0 END AS target_triagem
  FROM labelled WHERE situacao_candidato NOT IN ('prospect', 'inscrito') AND status_simplificado <> 'vazio')"""


@query(
    "screening_target",
    f"WITH {SQL_SCREENING} SELECT event_id, status_simplificado, target_triagem FROM screening",
)
def screening_target(spark: SparkSession, folder: str) -> DataFrame:
    labelled = shape.with_outcome(frames.links(spark, folder))
    rows = shape.screening_rows(shape.without_first_stages(labelled))
    return rows.select("event_id", "status_simplificado", "target_triagem")


@query(
    "hiring_target",
    f"""WITH {frames.SQL_OUTCOMES} SELECT event_id,
       CASE WHEN status_simplificado = 'contratado' THEN 1 ELSE 0 END AS target_contratacao
    FROM labelled WHERE status_simplificado IN ('contratado', 'negado')""",
)
def hiring_target(spark: SparkSession, folder: str) -> DataFrame:
    rows = shape.hiring_rows(shape.with_outcome(frames.links(spark, folder)))
    return rows.select("event_id", "target_contratacao")


@query(
    "stage_funnel",
    f"""WITH {frames.SQL_OUTCOMES}, marked AS (
      SELECT *, situacao_candidato IN ('prospect', 'inscrito') AS first_stage,
             CASE WHEN status_simplificado IN ('contratado', 'em_processo') THEN 1 ELSE 0 END AS t FROM labelled)
    SELECT count(*) AS n_start, count(*) FILTER (first_stage) AS n_first_stage,
       count(*) FILTER (NOT first_stage AND status_simplificado = 'vazio') AS n_unknown,
       count(*) FILTER (NOT first_stage AND status_simplificado <> 'vazio') AS n_kept,
       round(avg(t) FILTER (NOT first_stage AND status_simplificado <> 'vazio'), 3) AS target_rate
    FROM marked""",
)
def stage_funnel(spark: SparkSession, folder: str) -> DataFrame:
    labelled = shape.with_outcome(frames.links(spark, folder)).withColumn(
        "t", scalars.screening_target(col("status_simplificado"))
    )
    return profile.stage_funnel(labelled, "situacao_candidato", "status_simplificado", "t")


FEATURE_MAP = {
    "id": ["event_id", "cpf"],
    "date": ["data_candidatura"],
    "personal_info": ["codigo_applicant"],
    "leakage_risk": ["comentario", "recrutador"],
}


@query(
    "screening_table",
    f"""WITH {SQL_SCREENING} SELECT codigo_vaga, situacao_candidato, value, status_simplificado, target_triagem
    FROM screening""",
)
def screening_table(spark: SparkSession, folder: str) -> DataFrame:
    return shape.screening_table(frames.links(spark, folder), FEATURE_MAP)


LINE_ROLES = {
    "id": ["l_orderkey", "l_partkey", "l_id"],
    "date": ["l_shipdate"],
    "personal_info": ["l_suppkey", "l_nome"],
    "leakage_risk": ["l_returnflag"],
}


@query(
    "drop_by_role",
    """SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus FROM lineitem""",
)
def drop_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return shape.drop_roles(frames.table(spark, folder, "lineitem"), LINE_ROLES)[0]


@query(
    "project_and_reorder",
    """SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderpriority, o_orderdate::VARCHAR AS o_orderdate,
       CASE WHEN lower(trim(o_orderpriority)) = lower(trim(o_orderstatus)) THEN 1 ELSE 0 END AS igual
    FROM orders""",
)
def project_and_reorder(spark: SparkSession, folder: str) -> DataFrame:
    orders = frames.table(spark, folder, "orders")
    with_match = orders.withColumn(
        "igual", scalars.level_match(F.col("o_orderpriority"), F.col("o_orderstatus"))
    )
    ordered = shape.reorder(with_match, ["o_orderkey", "o_orderstatus"], ["igual"])
    return ordered.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _with_odd_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a constant, an all-null and a mostly-null column."""
    lines = frames.table(spark, folder, "lineitem")
    return lines.withColumns(
        {
            "constante": F.lit("x"),
            "sem_valor": F.lit(None).cast("string"),
            "rara": F.when(F.col("l_linenumber") == 7, F.col("l_linestatus")),
        }
    )


_LINE_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate::VARCHAR AS l_shipdate"""


@query(
    "drop_invalid",
    f"""SELECT {_LINE_COLUMNS}, CASE WHEN l_linenumber = 7 THEN l_linestatus END AS rara FROM lineitem""",
)
def drop_invalid(spark: SparkSession, folder: str) -> DataFrame:
    kept = profile.drop_invalid_columns(_with_odd_columns(spark, folder))
    return kept.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("clean_columns", f"SELECT {_LINE_COLUMNS} FROM lineitem")
def clean_columns(spark: SparkSession, folder: str) -> DataFrame:
    kept = profile.clean_columns(_with_odd_columns(spark, folder))
    return kept.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query(
    "filter_expression",
    f"""WITH {frames.SQL_OUTCOMES} SELECT event_id, codigo_vaga, value FROM labelled
    WHERE status_simplificado = 'contratado' AND value > 10""",
)
def filter_expression(spark: SparkSession, folder: str) -> DataFrame:
    labelled = shape.with_outcome(frames.links(spark, folder))
    hired = labelled.filter("status_simplificado = 'contratado' and value > 10")
    return hired.select("event_id", "codigo_vaga", "value")


# ---- prediction items -----------------------------------------------------------------

EXPECTED = ["canal", "event_type", "value", "k"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Events as string maps; errors lack a value, purchases have a field nobody expects."""
    fields = F.map_concat(
        F.create_map(F.lit("event_type"), F.col("event_type")),
        F.from_json("props", "map<string,string>"),
        F.when(F.col("event_type") != "error", F.create_map(F.lit("value"), F.col("value").cast("string")))
        .otherwise(F.from_json(F.lit("{}"), "map<string,string>")),
        F.when(F.col("event_type") == "purchase", F.create_map(F.lit("extra"), F.lit("sim")))
        .otherwise(F.from_json(F.lit("{}"), "map<string,string>")),
    )
    return frames.table(spark, folder, "events").select("event_id", fields.alias("features"))


_K = "CAST(json_extract_string(props, '$.k') AS VARCHAR)"


@query(
    "schema_align",
    f"""SELECT event_id, CAST(NULL AS VARCHAR) AS canal, event_type,
       CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) END AS value, {_K} AS k FROM events""",
)
def schema_align(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("event_id", *shape.align_map(F.col("features"), EXPECTED))


@query(
    "align_table",
    "SELECT o_orderpriority, CAST(NULL AS VARCHAR) AS canal, o_orderkey FROM orders",
)
def align_table(spark: SparkSession, folder: str) -> DataFrame:
    return shape.align(frames.table(spark, folder, "orders"), ["o_orderpriority", "canal", "o_orderkey"])


@query(
    "schema_warnings",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'canal,value' ELSE 'canal' END AS missing,
       CASE WHEN event_type = 'purchase' THEN 'extra' ELSE '' END AS unknown,
       CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS missing_count,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS unknown_count FROM events""",
)
def schema_warnings(spark: SparkSession, folder: str) -> DataFrame:
    rows = items(spark, folder)
    lists = shape.schema_warnings(F.col("features"), EXPECTED, "full")
    counts = shape.schema_warnings(F.col("features"), EXPECTED, "summary")
    return rows.select(
        "event_id",
        *[F.array_join(F.array_sort(c), ",").alias(n) for n, c in lists.items()],
        *[c.alias(n) for n, c in counts.items()],
    )


@query(
    "coerce_types",
    f"""SELECT event_id, '' AS canal, event_type,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CAST({_K} AS DOUBLE) AS k FROM events""",
)
def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    aligned = schema_align(spark, folder)
    return scalars.coerced(aligned, numbers=["value", "k"], categories=["canal", "event_type"])


@query(
    "coerce_by_content",
    f"""SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) END, '') AS value,
       CAST({_K} AS DOUBLE) AS k, event_type FROM events""",
)
def coerce_by_content(spark: SparkSession, folder: str) -> DataFrame:
    """``k`` reads as a number throughout; ``value`` does too but is declared a text."""
    rows = schema_align(spark, folder).select("event_id", "event_type", "value", "k")
    return scalars.coerced_by_content(rows, texts=["value"])


@query(
    "fill_nulls",
    """SELECT event_id, '' AS canal, event_type,
       coalesce(CASE WHEN event_type <> 'error' THEN value END, 0) AS value FROM events""",
)
def fill_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = scalars.coerced(
        schema_align(spark, folder).drop("k"), numbers=["value"], categories=[]
    )
    return scalars.filled(rows, texts=["canal", "event_type"])


@query(
    "job_candidate_merge",
    f"""WITH {frames.SQL_APPLICATIONS}
    SELECT a.doc_id, a.item_id, a.lang AS idioma, a.source AS origem, a.text AS texto,
       CAST(length(b.text) AS VARCHAR) AS tamanho
    FROM apps a JOIN benchmark b USING (item_id)""",
)
def job_candidate_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The job says a text, a size and a language; the candidate overrides text and language."""
    jobs = frames.table(spark, folder, "benchmark").select(
        "item_id",
        F.create_map(
            F.lit("texto"), F.col("text"),
            F.lit("tamanho"), F.char_length("text").cast("string"),
            F.lit("idioma"), F.lit("en"),
        ).alias("job_features"),
    )
    people = frames.applications(spark, folder).select(
        "doc_id",
        "item_id",
        F.create_map(
            F.lit("texto"), F.col("text"), F.lit("idioma"), F.col("lang"), F.lit("origem"), F.col("source")
        ).alias("candidate_features"),
    )
    merged = joins.job_candidate_features(people, jobs, "item_id", "job_features", "candidate_features")
    names = ["idioma", "origem", "texto", "tamanho"]
    return merged.select("doc_id", "item_id", *shape.align_map(F.col("features"), names))
