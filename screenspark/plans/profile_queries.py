"""Counts, rates, distributions and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.names import col
from screenspark.operators import joins, profile, shape
from screenspark.plans import frames
from screenspark.plans.registry import query


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return shape.with_outcome(frames.links(spark, folder))


@query(
    "value_counts",
    f"""WITH {frames.SQL_OUTCOMES} SELECT status_simplificado, count(*) AS n FROM labelled GROUP BY 1""",
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(_labelled(spark, folder), "status_simplificado")


@query(
    "value_share",
    f"""WITH {frames.SQL_OUTCOMES} SELECT status_simplificado,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 6) AS pct FROM labelled GROUP BY 1""",
)
def value_share(spark: SparkSession, folder: str) -> DataFrame:
    shares = profile.value_shares(_labelled(spark, folder), "status_simplificado")
    return shares.withColumn("pct", F.round("pct", 6))


@query(
    "candidates_per_job",
    f"""WITH {frames.SQL_LINKS} SELECT codigo_vaga, count(DISTINCT codigo_applicant) AS n_candidatos
    FROM links GROUP BY 1""",
)
def candidates_per_job(spark: SparkSession, folder: str) -> DataFrame:
    links = frames.links(spark, folder)
    return profile.distinct_per_group(links, "codigo_vaga", "codigo_applicant", "n_candidatos")


@query(
    "hired_per_job",
    f"""WITH {frames.SQL_OUTCOMES}, c AS (SELECT codigo_vaga, count(DISTINCT codigo_applicant) AS n_candidatos
      FROM labelled GROUP BY 1),
    h AS (SELECT codigo_vaga, count(DISTINCT codigo_applicant) AS n_contratados FROM labelled
      WHERE status_simplificado = 'contratado' GROUP BY 1)
    SELECT codigo_vaga, n_candidatos, coalesce(n_contratados, 0) AS n_contratados
    FROM c LEFT JOIN h USING (codigo_vaga)""",
)
def hired_per_job(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    everyone = profile.distinct_per_group(rows, "codigo_vaga", "codigo_applicant", "n_candidatos")
    hired = profile.distinct_per_group(
        rows.filter("status_simplificado = 'contratado'"), "codigo_vaga", "codigo_applicant", "n_contratados"
    )
    return joins.left_join_counts(everyone, hired, "codigo_vaga", ["n_contratados"])


@query(
    "hire_rate",
    f"""WITH {frames.SQL_OUTCOMES} SELECT codigo_vaga, count(DISTINCT codigo_applicant) AS n_candidatos,
       count(DISTINCT CASE WHEN status_simplificado = 'contratado' THEN codigo_applicant END) AS n_contratados,
       round(count(DISTINCT CASE WHEN status_simplificado = 'contratado' THEN codigo_applicant END)::DOUBLE
             / count(DISTINCT codigo_applicant), 6) AS taxa_contratacao
    FROM labelled GROUP BY 1""",
)
def hire_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    hired = col("status_simplificado") == "contratado"
    rates = profile.hire_rates(rows, "codigo_vaga", "codigo_applicant", hired)
    return rates.withColumn("taxa_contratacao", F.round("taxa_contratacao", 6))


@query(
    "count_of_counts",
    f"""WITH {frames.SQL_LINKS}, c AS (SELECT codigo_vaga, count(DISTINCT codigo_applicant) AS n_candidatos
      FROM links GROUP BY 1)
    SELECT n_candidatos, count(*) AS n_groups FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def count_of_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count_of_counts(candidates_per_job(spark, folder), "n_candidatos")


def _described(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS feature, count({name}) AS count, round(avg({name}), 4) AS mean,
       round(stddev_samp({name}), 4) AS std, CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max,
       round(quantile_cont({name}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({name}::DOUBLE, 0.5), 6) AS p50,
       round(quantile_cont({name}::DOUBLE, 0.75), 6) AS p75 FROM {table}"""


DESCRIBED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("describe", " UNION ALL ".join(_described(n, "lineitem") for n in DESCRIBED))
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.describe(frames.table(spark, folder, "lineitem"), DESCRIBED))


@query(
    "describe_counts",
    f"""WITH per_job AS (SELECT o_custkey, count(*) AS n_candidatos FROM orders GROUP BY 1)
    {_described("n_candidatos", "per_job")}""",
)
def describe_counts(spark: SparkSession, folder: str) -> DataFrame:
    per_job = frames.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_candidatos")
    )
    return _rounded(profile.describe(per_job, ["n_candidatos"]))


def _rounded(described: DataFrame) -> DataFrame:
    digits = {"mean": 4, "std": 4, "p25": 6, "p50": 6, "p75": 6}
    return described.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "histogram30",
    """WITH ends AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
    hits AS (SELECT least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 29) AS bin, count(*) AS n
             FROM orders, ends GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 4) AS bin_start, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN ends LEFT JOIN hits USING (bin)""",
)
def histogram30(spark: SparkSession, folder: str) -> DataFrame:
    bins = profile.histogram(frames.table(spark, folder, "orders"), "o_totalprice")
    return bins.withColumn("bin_start", F.round("bin_start", 4))


def _documents_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (frames.table(spark, folder, n) for n in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left")


PROFILED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_FULL = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _missing(name: str) -> str:
    return f"sum(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*)"


@query(
    "missing_and_cardinality",
    f"WITH t AS ({_FULL}) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round({_missing(n)}, 6) AS missing_rate, count(DISTINCT {n}) AS nunique FROM t"
        for n in PROFILED
    ),
)
def missing_and_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.missing_and_cardinality(_documents_with_labels(spark, folder))
    return found.withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "most_missing",
    f"WITH t AS ({_FULL}) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round({_missing(n)}, 6) AS missing_rate FROM t" for n in PROFILED
    )
    + " ORDER BY missing_rate DESC, feature LIMIT 3",
)
def most_missing(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.missing_and_cardinality(_documents_with_labels(spark, folder))
    return profile.most_missing(found, 3).withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "cardinality_extremes",
    f"WITH t AS ({_FULL}), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(DISTINCT {n}) AS nunique FROM t" for n in PROFILED)
    + """) SELECT * FROM (SELECT feature, nunique, 'head' AS part FROM c ORDER BY nunique DESC, feature LIMIT 2)
    UNION ALL SELECT * FROM (SELECT feature, nunique, 'tail' AS part FROM c ORDER BY nunique, feature DESC LIMIT 2)""",
)
def cardinality_extremes(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.missing_and_cardinality(_documents_with_labels(spark, folder))
    head = profile.most_varied(found, 2).withColumn("part", F.lit("head"))
    return head.unionByName(profile.least_varied(found, 2).withColumn("part", F.lit("tail")))


def _profiled(name: str) -> str:
    kind = (
        f"CASE WHEN sum(length(coalesce({name}, 'nan')))::DOUBLE / count(*) > 50 THEN 'text' ELSE 'categorical' END"
        if name in ("text", "lang", "source")
        else "'numeric'"
    )
    return f"""SELECT '{name}' AS coluna, {kind} AS tipo, round({_missing(name)}, 3) AS missing_rate,
       count(DISTINCT {name}) AS nunique FROM t"""


@query("column_profile", f"WITH t AS ({_FULL}) " + " UNION ALL ".join(_profiled(n) for n in PROFILED))
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.column_profile(_documents_with_labels(spark, folder))
    return profile.sorted_profile(found)


AUDITED = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


def _audited(name: str, kind: str) -> str:
    return f"""SELECT '{name}' AS coluna, '{kind}' AS dtype, count(DISTINCT {name}) AS n_unique,
       round({_missing(name)}, 4) AS missing_ratio,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({name} AS VARCHAR) AS v FROM orders
        WHERE {name} IS NOT NULL ORDER BY v LIMIT 5)) AS exemplos FROM orders"""


@query("column_audit", " UNION ALL ".join(_audited(n, k) for n, k in AUDITED.items()))
def column_audit(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_audit(frames.table(spark, folder, "orders"))


@query(
    "class_balance",
    """SELECT count(*) FILTER (quality = 0) AS neg, count(*) FILTER (quality = 1) AS pos,
       round(avg(quality), 3) AS target_rate,
       round(count(*) FILTER (quality = 0)::DOUBLE / greatest(1, count(*) FILTER (quality = 1)), 6) AS scale_pos_weight
    FROM labels""",
)
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    balance = profile.class_balance(frames.table(spark, folder, "labels"), "quality")
    return balance.withColumn("scale_pos_weight", F.round("scale_pos_weight", 6))


@query(
    "table_shape",
    "SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT o_custkey) AS n_keys FROM orders",
)
def table_shape(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_shape(frames.table(spark, folder, "orders"), "o_custkey")


@query(
    "aligned_counts",
    f"""WITH {frames.SQL_DRIFT_SIDES} """
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {n}::VARCHAR AS value, CAST(sum(is_ref) AS BIGINT) AS ref_c,
        CAST(sum(1 - is_ref) AS BIGINT) AS prod_c FROM sides WHERE {n} IS NOT NULL GROUP BY 2"""
        for n in frames.DRIFT_TEXTS
    ),
)
def aligned_counts(spark: SparkSession, folder: str) -> DataFrame:
    return joins.aligned_counts(*frames.drift_sides(spark, folder), frames.DRIFT_TEXTS)
