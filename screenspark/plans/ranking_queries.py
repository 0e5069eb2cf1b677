"""Top-k, first rows, split, imputation, scaling, metrics, payloads and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.functions.scalars import normalized_id
from screenspark.operators import encode, metrics, payload, profile, questions, ranking, split
from screenspark.operators.joins import skew_join
from screenspark.plans import frames
from screenspark.plans.registry import query

# ---- top-k and first rows -------------------------------------------------------------


def _scored_applications(spark: SparkSession, folder: str) -> DataFrame:
    score = frames.length_score().alias("score")
    return frames.applications(spark, folder).select("doc_id", "item_id", "lang", score)


SQL_SCORED_APPS = f"""{frames.SQL_APPLICATIONS}, sapps AS (
  SELECT doc_id, item_id, lang, {frames.SQL_LENGTH_SCORE} AS score FROM apps)"""


@query(
    "top_k_per_job",
    f"""WITH {SQL_SCORED_APPS}, r AS (SELECT *, row_number() OVER (
        PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sapps)
    SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank,
       CASE WHEN score >= 0.6::DOUBLE THEN 1 ELSE 0 END AS label FROM r WHERE rank <= 5""",
)
def top_k_per_job(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.top_k_per_group(_scored_applications(spark, folder), "item_id", "score", "doc_id")
    return best.select("item_id", "doc_id", "score", "rank", "label")


@query(
    "score_summary",
    f"""WITH {SQL_SCORED_APPS} SELECT item_id, count(*) AS n_candidates, round(avg(score), 6) AS prob_avg,
       min(score) AS prob_min, max(score) AS prob_max FROM sapps GROUP BY 1""",
)
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = profile.score_summary(_scored_applications(spark, folder), "item_id", "score")
    return summary.withColumn("prob_avg", F.round("prob_avg", 6))


@query(
    "dedupe_first",
    f"""WITH {frames.SQL_LINKS}, r AS (SELECT *, row_number() OVER (
        PARTITION BY codigo_vaga, codigo_applicant ORDER BY event_id) AS n FROM links)
    SELECT codigo_vaga, codigo_applicant, event_id, value FROM r WHERE n = 1""",
)
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    unique = ranking.dedupe_candidates(frames.links(spark, folder), "event_id")
    return unique.select("codigo_vaga", "codigo_applicant", "event_id", "value")


@query(
    "dedupe_by_text",
    f"""WITH {frames.SQL_APPLICATIONS} SELECT item_id, min(doc_id) AS doc_id FROM apps GROUP BY item_id, text""",
)
def dedupe_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """Without a candidate id, equal CV texts within a job are one candidate."""
    apps = frames.applications(spark, folder).withColumnRenamed("text", "cv_pt")
    unique = ranking.dedupe_candidates(apps, "doc_id", job_key="item_id")
    return unique.select("item_id", "doc_id")


@query(
    "first_per_job",
    f"""WITH {frames.SQL_LINKS} SELECT codigo_vaga, arg_min(codigo_applicant, event_id) AS codigo_applicant,
       arg_min(value, event_id) AS value FROM links GROUP BY 1""",
)
def first_per_job(spark: SparkSession, folder: str) -> DataFrame:
    links = frames.links(spark, folder)
    return ranking.group_fields(links, "codigo_vaga", "event_id", ["codigo_applicant", "value"])


@query(
    "sample_keys",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events ORDER BY 1 LIMIT 15",
)
def sample_keys(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.sample_keys(frames.table(spark, folder, "events"), "user_id")


@query(
    "group_split",
    """WITH g AS (SELECT DISTINCT o_custkey, md5('42|' || CAST(o_custkey AS VARCHAR)) AS h FROM orders),
    r AS (SELECT o_custkey, row_number() OVER (ORDER BY h) AS n, count(*) OVER () AS total FROM g)
    SELECT o.o_orderkey, o.o_custkey, CASE WHEN n <= ceil(0.2::DOUBLE * total) THEN 1 ELSE 0 END AS is_test
    FROM orders o JOIN r USING (o_custkey)""",
)
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    marked = split.with_group_split(frames.table(spark, folder, "orders"), "o_custkey")
    return marked.select("o_orderkey", "o_custkey", "is_test")


# ---- imputation and scaling -----------------------------------------------------------


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (frames.table(spark, folder, n) for n in ("documents", "labels"))
    joined = docs.join(labels, "doc_id", "left")
    # Labelled documents only have a length, a language and a source.
    known = F.col("quality").isNotNull()
    return joined.select(
        "doc_id",
        F.when(known, F.col("n_chars")).cast("double").alias("n_chars"),
        F.when(known, F.col("lang")).alias("lang"),
        F.when(known, F.col("source")).alias("source"),
    )


SQL_GAPPY = """gappy AS (SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN n_chars::DOUBLE END AS n_chars,
  CASE WHEN quality IS NOT NULL THEN lang END AS lang, CASE WHEN quality IS NOT NULL THEN source END AS source
  FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(
    "impute_median",
    f"""WITH {SQL_GAPPY} SELECT doc_id, coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM gappy)) AS n_chars
    FROM gappy""",
)
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    return encode.impute_medians(_gappy(spark, folder), ["n_chars"]).select("doc_id", "n_chars")


def _sql_mode(name: str) -> str:
    return f"(SELECT {name} FROM gappy WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "impute_mode",
    f"""WITH {SQL_GAPPY} SELECT doc_id, coalesce(lang, {_sql_mode("lang")}) AS lang,
       coalesce(source, {_sql_mode("source")}) AS source FROM gappy""",
)
def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    return encode.impute_modes(_gappy(spark, folder), ["lang", "source"]).select("doc_id", "lang", "source")


@query(
    "standard_scale",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_tax) AS ta, stddev_pop(l_tax) AS ts
                FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / s, 6) AS l_quantity,
       round((l_tax - ta) / ts, 6) AS l_tax, 3.0::DOUBLE - 3.0 AS fixa FROM lineitem, m""",
)
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    lines = frames.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", F.lit(3.0).alias("fixa")
    )
    scaled = encode.standard_scale(lines, ["l_quantity", "l_tax", "fixa"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query(
    "scale_without_mean",
    """SELECT l_orderkey, l_linenumber, l_partkey,
       round(l_quantity / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem""",
)
def scale_without_mean(spark: SparkSession, folder: str) -> DataFrame:
    lines = frames.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    scaled = encode.standard_scale(lines, ["l_quantity"], with_mean=False)
    return scaled.withColumn("l_quantity", F.round("l_quantity", 6))


# ---- metrics --------------------------------------------------------------------------


@query(
    "roc_auc",
    f"""WITH {frames.SQL_SCORED}, s AS (SELECT score, sum(y_true) AS p, sum(1 - y_true) AS n FROM scored GROUP BY 1),
    c AS (SELECT *, sum(n) OVER (ORDER BY score) - n / 2.0::DOUBLE AS below FROM s)
    SELECT round(sum(p * below) / (sum(p)::DOUBLE * sum(n)), 6) AS roc_auc FROM c""",
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_auc(frames.scored(spark, folder)).withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    "average_precision",
    f"""WITH {frames.SQL_SCORED}, s AS (SELECT score, sum(y_true) AS p, count(*) AS n FROM scored GROUP BY 1),
    c AS (SELECT *, sum(p) OVER (ORDER BY score DESC)::DOUBLE / sum(n) OVER (ORDER BY score DESC) AS prec FROM s)
    SELECT round(sum(p * prec) / sum(p), 6) AS average_precision FROM c""",
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.average_precision(frames.scored(spark, folder))
    return found.withColumn("average_precision", F.round("average_precision", 6))


@query(
    "recall_at_k",
    f"""WITH {frames.SQL_SCORED}, r AS (SELECT y_true, row_number() OVER (ORDER BY score DESC, doc_id) AS i,
         CAST(floor(count(*) OVER () * 0.2::DOUBLE) AS BIGINT) AS n_taken FROM scored)
    SELECT round(sum(CASE WHEN i <= n_taken THEN y_true ELSE 0 END)::DOUBLE / sum(y_true), 6) AS recall,
       max(n_taken) AS n_taken FROM r""",
)
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.recall_at(frames.scored(spark, folder), 0.2, tie="doc_id")
    return found.withColumn("recall", F.round("recall", 6))


@query(
    "f1_score",
    f"""WITH {frames.SQL_SCORED} SELECT round(2.0::DOUBLE * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)), 6) AS f1
    FROM scored""",
)
def f1_score(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.f1_score(frames.scored(spark, folder)).withColumn("f1", F.round("f1", 6))


@query(
    "confusion_matrix",
    f"""WITH {frames.SQL_SCORED} SELECT CAST(t AS INTEGER) AS y_true, CAST(p AS INTEGER) AS y_pred,
       (SELECT count(*) FROM scored WHERE y_true = t AND y_pred = p) AS n
    FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) cells(t, p)""",
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(frames.scored(spark, folder))


@query(
    "classification_report",
    f"""WITH {frames.SQL_SCORED}, c AS (SELECT sum(y_true * y_pred)::DOUBLE AS tp,
         sum((1 - y_true) * y_pred)::DOUBLE AS fp, sum(y_true * (1 - y_pred))::DOUBLE AS fn,
         sum((1 - y_true) * (1 - y_pred))::DOUBLE AS tn FROM scored),
    m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS n0,
         tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, tp + fn AS n1,
         (tp + tn) / (tp + tn + fp + fn) AS acc FROM c),
    u AS (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM m
      UNION ALL SELECT '1', p1, r1, f1, n1 FROM m
      UNION ALL SELECT 'accuracy', NULL, NULL, acc, n0 + n1 FROM m
      UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM m
      UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
        (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM m)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM u""",
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.classification_report(frames.scored(spark, folder))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- payloads and questions -----------------------------------------------------------


def _payload_base(spark: SparkSession, folder: str) -> DataFrame:
    """Applications with their job's text; ids as a float round trip leaves them."""
    jobs = frames.table(spark, folder, "benchmark").select(
        "item_id", F.col("text").alias("perfil_vaga.principais_atividades")
    )
    apps = skew_join(frames.applications(spark, folder), jobs, "item_id")
    return apps.select(
        "doc_id",
        F.concat(F.col("item_id").cast("string"), F.lit(".0")).alias("codigo_vaga"),
        F.col("doc_id").cast("string").alias("codigo_applicant"),
        "lang",
        "n_chars",
        F.col("text").alias("cv_pt"),
        "`perfil_vaga.principais_atividades`",
    )


_JOB_FIELDS = ["perfil_vaga.principais_atividades", "perfil_vaga.demais_observacoes"]
_CANDIDATE_FIELDS = ["cv_pt", "lang", "n_chars", "salario"]
_SQL_CANDIDATE = """'{"meta":{"external_id":"' || CAST(doc_id AS VARCHAR) || '"},"candidato":'
  || CAST(to_json({'cv_pt': a.text, 'lang': lang, 'n_chars': n_chars::DOUBLE}) AS VARCHAR) || '}'"""
_SQL_JOB = """'{"perfil_vaga.principais_atividades":' || CAST(to_json(b.text) AS VARCHAR) || '}'"""


@query(
    "job_payload",
    f"""WITH {frames.SQL_APPLICATIONS}, r AS (SELECT a.item_id, {_SQL_CANDIDATE} AS person,
        row_number() OVER (PARTITION BY a.item_id ORDER BY CAST(doc_id AS VARCHAR)) AS n, {_SQL_JOB} AS job
      FROM apps a JOIN benchmark b USING (item_id))
    SELECT CAST(item_id AS VARCHAR) AS codigo_vaga, CAST(count(*) AS INTEGER) AS n_candidates,
       '{{"vaga":' || any_value(job) || ',"candidatos":[' || string_agg(person, ',' ORDER BY n) || ']}}' AS payload
    FROM r WHERE n <= 3 GROUP BY 1""",
)
def job_payload(spark: SparkSession, folder: str) -> DataFrame:
    base = _payload_base(spark, folder)
    return payload.job_payloads(base, "doc_id", _JOB_FIELDS, _CANDIDATE_FIELDS, top_n=3)


@query(
    "payload_rows",
    f"""WITH {frames.SQL_APPLICATIONS} SELECT CAST(a.item_id AS VARCHAR) AS codigo_vaga,
       CAST(doc_id AS VARCHAR) AS external_id, {_SQL_CANDIDATE} AS candidate_payload, {_SQL_JOB} AS job_payload
    FROM apps a JOIN benchmark b USING (item_id)""",
)
def payload_rows(spark: SparkSession, folder: str) -> DataFrame:
    base = _payload_base(spark, folder)
    rows = payload.payload_rows(base, "doc_id", _JOB_FIELDS, _CANDIDATE_FIELDS)
    return rows.select("codigo_vaga", "external_id", "candidate_payload", "job_payload")


def _sql_cut(expr: str) -> str:
    return f"CASE WHEN length({expr}) > 2000 THEN left({expr}, 2000) || '...' ELSE {expr} END"


def _sql_prompt() -> str:
    from screenspark import fixed_values as fixed

    head = " || chr(10) || ".join(frames.sql_text(x) for x in fixed.PROMPT_HEAD)
    return f"""WITH {SQL_SCORED_APPS}, r AS (SELECT s.item_id, s.doc_id, row_number() OVER (
        PARTITION BY s.item_id ORDER BY score DESC, s.doc_id) AS rank FROM sapps s),
    p AS (SELECT r.item_id, count(*) AS n, string_agg('- id=' || CAST(r.doc_id AS VARCHAR) || ': ' || {_sql_cut("d.text")},
        chr(10) ORDER BY rank) AS people FROM r JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY 1)
    SELECT item_id, CAST(n AS INTEGER) AS n_candidates, {head} || chr(10) || 'Descricao: ' || {_sql_cut("b.text")}
       || chr(10) || 'Requisitos: ' || chr(10) || 'Atividades: ' || {_sql_cut("b.text")} || chr(10) || chr(10)
       || 'CANDIDATOS:' || chr(10) || people || chr(10) || chr(10) || {frames.sql_text(fixed.PROMPT_TAIL)} AS prompt
    FROM p JOIN benchmark b USING (item_id)"""


@query("prompt_text", _sql_prompt())
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.top_k_per_group(_scored_applications(spark, folder), "item_id", "score", "doc_id")
    cvs = frames.table(spark, folder, "documents").select("doc_id", F.col("text").alias("cv_pt"))
    jobs = frames.table(spark, folder, "benchmark").select(
        "item_id", F.col("text").alias("perfil_vaga.principais_atividades")
    )
    fields = questions.prompt_fields(jobs, "item_id")
    return questions.prompt_texts(best.join(cvs, "doc_id"), fields, "item_id", "doc_id", "cv_pt", "rank")


@query(
    "reply_normalize",
    """WITH r AS (SELECT conv_id, turn, role, string_split(text, '. ') AS qs FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN array_to_string(qs[1:5], '|') ELSE '' END AS common_questions,
       CASE WHEN role = 'assistant' THEN array_to_string(qs[1:3], '|') ELSE '' END AS own_questions,
       '' AS absent_questions, 2 AS n_ids FROM r""",
)
def reply_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as replies wrapped in talk; other turns are unreadable replies."""
    own = F.col("conv_id").cast("string")
    parts = F.split("text", "\\. ")
    body = F.to_json(
        F.struct(
            parts.alias("common_questions"),
            F.create_map(own, parts, F.lit("outro"), parts).alias("per_candidate"),
        )
    )
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("Segue: "), body, F.lit(" fim"))).otherwise(
        F.col("text")
    )
    common, each = questions.normalized_reply(reply, F.array(own, F.lit("ninguem")))
    rows = frames.table(spark, folder, "conversations").select(
        "conv_id", "turn", common.alias("common"), each.alias("each")
    )
    return rows.select(
        "conv_id",
        "turn",
        F.array_join("common", "|").alias("common_questions"),
        F.array_join(F.try_element_at("each", own), "|").alias("own_questions"),
        F.array_join(F.try_element_at("each", F.lit("ninguem")), "|").alias("absent_questions"),
        F.size("each").alias("n_ids"),
    )


@query(
    "one_job",
    f"""WITH {frames.SQL_LINKS} SELECT event_id, codigo_vaga FROM links
    WHERE codigo_vaga = (SELECT min(CAST(user_id AS VARCHAR)) FROM events)""",
)
def one_job(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the job with the smallest id, asked for as a float id."""
    links = frames.links(spark, folder)
    smallest = links.agg(F.min("codigo_vaga")).first()[0]
    rows = ranking.require_job(links, "codigo_vaga", f"{smallest}.0")
    return rows.select("event_id", normalized_id(F.col("codigo_vaga")).alias("codigo_vaga"))
