"""Text functions, token sets, vocabularies, TF-IDF weights and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.functions import scalars, text
from screenspark.operators import ranking, tfidf
from screenspark.operators.joins import skew_join
from screenspark.plans import frames
from screenspark.plans.registry import query


@query("normalize_text", f"SELECT doc_id, {frames.sql_normalized('text')} AS clean FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = tfidf.spread_if_small(frames.table(spark, folder, "documents"))
    return docs.select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


@query(
    "tokenize",
    f"""WITH {frames.sql_tokens("documents", "doc_id", "text")}
    SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2""",
)
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    docs = tfidf.spread_if_small(frames.table(spark, folder, "documents"))
    counted = F.explode(text.term_counts(text.tokens(F.col("text"))))
    return docs.select("doc_id", counted.alias("t")).select(
        "doc_id", "t.term", F.col("t.tf").cast("bigint").alias("tf")
    )


@query(
    "token_lists",
    f"""WITH s AS (SELECT doc_id, string_split({frames.sql_normalized("text")}, ' ') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM s),
    k AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS words FROM w
          WHERE term <> '' AND term NOT IN {frames.SQL_STOP} GROUP BY 1)
    SELECT doc_id, coalesce(k.words, '') AS words FROM documents LEFT JOIN k USING (doc_id)""",
)
def token_lists(spark: SparkSession, folder: str) -> DataFrame:
    docs = tfidf.spread_if_small(frames.table(spark, folder, "documents"))
    return docs.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("words"))


def _pair_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Applications with the token sets of both sides: built once per text, then joined on the job key."""
    jobs = frames.table(spark, folder, "benchmark").select("item_id", text.token_set(F.col("text")).alias("a"))
    apps = tfidf.spread_if_small(frames.applications(spark, folder))
    sets = apps.select("doc_id", "item_id", text.token_set(F.col("text")).alias("b"))
    return skew_join(sets, jobs, "item_id")


SQL_SETS = f"""{frames.SQL_APPLICATIONS},
{frames.sql_tokens("documents", "doc_id", "text", "dt")},
{frames.sql_tokens("benchmark", "item_id", "text", "jt")},
ds AS (SELECT DISTINCT doc_id, term FROM dt), js AS (SELECT DISTINCT item_id, term FROM jt),
dn AS (SELECT doc_id, count(*) AS nd FROM ds GROUP BY 1), jn AS (SELECT item_id, count(*) AS nj FROM js GROUP BY 1),
shared AS (SELECT a.doc_id, count(*) AS n FROM apps a JOIN ds USING (doc_id)
           JOIN js ON js.item_id = a.item_id AND js.term = ds.term GROUP BY 1)"""


@query(
    "jaccard",
    f"""WITH {SQL_SETS}
    SELECT a.doc_id, round(CASE WHEN nd IS NULL OR nj IS NULL THEN 0.0::DOUBLE
       ELSE coalesce(n, 0)::DOUBLE / (nd + nj - coalesce(n, 0)) END, 6) AS overlap_skills
    FROM apps a LEFT JOIN dn USING (doc_id) LEFT JOIN jn USING (item_id) LEFT JOIN shared USING (doc_id)""",
)
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    overlap = text.jaccard(F.col("a"), F.col("b"))
    return _pair_sets(spark, folder).select("doc_id", F.round(overlap, 6).alias("overlap_skills"))


@query(
    "token_set_sizes",
    f"""WITH {SQL_SETS}
    SELECT a.doc_id, coalesce(n, 0) AS n_shared,
       coalesce(nd, 0) + coalesce(nj, 0) - coalesce(n, 0) AS n_union
    FROM apps a LEFT JOIN dn USING (doc_id) LEFT JOIN jn USING (item_id) LEFT JOIN shared USING (doc_id)""",
)
def token_set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_sets(spark, folder).select(
        "doc_id",
        F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_shared"),
        F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"),
    )


@query(
    "level_match",
    """SELECT conv_id, turn, CASE WHEN lower(trim(role)) = lower(trim('  ASSISTANT ')) THEN 1 ELSE 0 END AS match
    FROM conversations""",
)
def level_match(spark: SparkSession, folder: str) -> DataFrame:
    match = scalars.level_match(F.lit("  ASSISTANT "), F.col("role"))
    return frames.table(spark, folder, "conversations").select("conv_id", "turn", match.alias("match"))


@query(
    "concat_text",
    """SELECT d.doc_id, d.lang || ' ' || d.text || ' ' || coalesce(CAST(l.quality AS VARCHAR), '') AS all_text
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def concat_text(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (frames.table(spark, folder, n) for n in ("documents", "labels"))
    joined = docs.join(labels, "doc_id", "left")
    parts = text.join_texts([F.col("lang"), F.col("text"), F.col("quality")])
    return joined.select("doc_id", parts.alias("all_text"))


@query(
    "normalize_ids",
    """SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN CAST(user_id AS VARCHAR) || '.5'
       ELSE CAST(user_id AS VARCHAR) END AS codigo FROM events""",
)
def normalize_ids(spark: SparkSession, folder: str) -> DataFrame:
    """User ids as a float round trip and hand typing leave them."""
    number = F.col("user_id").cast("string")
    raw = (
        F.when(F.col("event_type") == "error", F.lit(" NaN "))
        .when(F.col("event_type") == "view", F.concat(number, F.lit(".5")))
        .when(F.col("event_type") == "click", F.concat(F.lit("\t"), number, F.lit(".0 ")))
        .otherwise(number)
    )
    return frames.table(spark, folder, "events").select("event_id", scalars.normalized_id(raw).alias("codigo"))


@query(
    "truncate",
    """SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS short
    FROM documents""",
)
def truncate(spark: SparkSession, folder: str) -> DataFrame:
    return frames.table(spark, folder, "documents").select(
        "doc_id", text.truncated(F.col("text"), 2000).alias("short")
    )


@query(
    "extract_json",
    """WITH r AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Segue: {"t": "' || md5(text) || '"} fim'
         WHEN 'system' THEN ' {"a": {"b": 1}} ' ELSE text END AS reply FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(reply, '{') AND contains(reply, '}')
       THEN regexp_extract(reply, '\\{(.|\\n)*\\}', 0)
       ELSE regexp_replace(reply, '^\\s+|\\s+$', '', 'g') END AS block FROM r""",
)
def extract_json(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.md5(F.col("text").cast("binary"))
    reply = (
        F.when(F.col("role") == "assistant", F.concat(F.lit('Segue: {"t": "'), digest, F.lit('"} fim')))
        .when(F.col("role") == "system", F.lit(' {"a": {"b": 1}} '))
        .otherwise(F.col("text"))
    )
    return frames.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.json_block(reply).alias("block")
    )


@query(
    "input_signature",
    """SELECT event_id, left(sha256('{"event_type": "' || event_type || '", "props": "'
         || replace(props, '"', chr(92) || '"') || '", "value": '
         || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || CAST(value AS VARCHAR) || '"' END || '}'), 16) AS sig
    FROM events""",
)
def input_signature(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value").cast("string"))
    features = F.create_map(
        F.lit("value"), value, F.lit("props"), F.col("props"), F.lit("event_type"), F.col("event_type")
    )
    return frames.table(spark, folder, "events").select(
        "event_id", scalars.input_signature(features).alias("sig")
    )


@query(
    "typed_payload",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN '{"lang":"' || lang || '","n_chars":'
         || CAST(n_chars::DOUBLE AS VARCHAR) || '}'
       ELSE '{"lang":"' || lang || '","n_chars":' || CAST(n_chars::DOUBLE AS VARCHAR) || ',"quality":'
         || CAST(quality::DOUBLE AS VARCHAR) || '}' END AS body
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def typed_payload(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (frames.table(spark, folder, n) for n in ("documents", "labels"))
    joined = docs.join(labels, "doc_id", "left")
    return joined.select("doc_id", scalars.compact_json(joined, ["lang", "n_chars", "quality"]).alias("body"))


@query(
    "threshold_label",
    f"""WITH {frames.SQL_SCORED} SELECT doc_id, CASE WHEN score >= 0.6::DOUBLE THEN 1 ELSE 0 END AS label
    FROM scored""",
)
def threshold_label(spark: SparkSession, folder: str) -> DataFrame:
    return frames.scored(spark, folder).select(
        "doc_id", scalars.threshold_label(F.col("score"), 0.6).alias("label")
    )


# ---- TF-IDF ---------------------------------------------------------------------------


def sql_vocabulary(tokens: str, n_docs: str, size: int, low: float, high: float) -> str:
    """CTE ``vocab`` from ``tokens`` (doc, uses, term): bounds, then most counted, ties by term."""
    return f"""ndocs AS ({n_docs}),
stats AS (SELECT term, sum(uses) AS tf, sum(CASE WHEN first THEN uses ELSE 0 END) AS df FROM (
    SELECT term, uses, row_number() OVER (PARTITION BY doc, term) = 1 AS first FROM {tokens}) GROUP BY 1),
vocab AS (SELECT term, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf,
      ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM stats, ndocs
    WHERE df >= {low} AND df <= {high} ORDER BY tf DESC, term LIMIT {size})"""


def sql_weights(tokens: str, name: str) -> str:
    """CTE ``name`` (doc, term, w) with L2-normalised TF-IDF weights."""
    return f"""{name}_raw AS (SELECT doc, t.term, count(*) * any_value(idf) AS w
    FROM {tokens} t JOIN vocab v ON v.term = t.term GROUP BY 1, 2),
{name}_norm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM {name}_raw GROUP BY 1),
{name} AS (SELECT doc, term, w / norm AS w FROM {name}_raw JOIN {name}_norm USING (doc))"""


SQL_PAIR_VOCABULARY = f"""{frames.SQL_APPLICATIONS},
{frames.sql_tokens("documents", "doc_id", "text", "dt")},
{frames.sql_tokens("benchmark", "item_id", "text", "jt")},
uses AS (SELECT item_id, count(*) AS uses FROM apps GROUP BY 1),
all_tokens AS (
  SELECT 'd' || doc_id AS doc, 1 AS uses, term FROM dt
  UNION ALL SELECT 'j' || item_id AS doc, uses, term FROM jt JOIN uses USING (item_id)),
{sql_vocabulary("all_tokens", "SELECT 2 * count(*) AS n FROM documents", 2000, 3, "0.9::DOUBLE * n")},
cv_tokens AS (SELECT doc_id AS doc, term FROM dt), job_tokens AS (SELECT item_id AS doc, term FROM jt)"""


def _pair_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        frames.pairs(spark, folder),
        frames.table(spark, folder, "documents").select("doc_id", "text"),
        frames.table(spark, folder, "benchmark").select("item_id", "text"),
    )


def _pair_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    pairs, docs, jobs = _pair_inputs(spark, folder)
    return tfidf.pair_vocabulary(pairs, docs, jobs, "item_id", "doc_id")


@query(
    "corpus_union",
    f"""WITH {frames.SQL_APPLICATIONS} SELECT text, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT text, count(*) AS n FROM apps GROUP BY 1
      UNION ALL SELECT b.text, count(*) AS n FROM apps JOIN benchmark b USING (item_id) GROUP BY 1) GROUP BY 1""",
)
def corpus_union(spark: SparkSession, folder: str) -> DataFrame:
    texts = tfidf.corpus(*_pair_inputs(spark, folder), "item_id", "doc_id")
    return texts.groupBy("text").agg(F.sum("weight").alias("n"))


@query(
    "tfidf_vocab",
    f"WITH {SQL_PAIR_VOCABULARY} SELECT term, df, tf, round(idf, 6) AS idf FROM vocab",
)
def tfidf_vocab(spark: SparkSession, folder: str) -> DataFrame:
    vocab = _pair_vocabulary(spark, folder)
    return vocab.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_weights",
    f"""WITH {SQL_PAIR_VOCABULARY}, {sql_weights("cv_tokens", "cvw")}
    SELECT doc AS doc_id, term, round(w, 6) AS w FROM cvw""",
)
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = frames.table(spark, folder, "documents")
    rows = tfidf.weights(docs, "doc_id", _pair_vocabulary(spark, folder), tfidf.SIMILARITY)
    return rows.withColumn("w", F.round("w", 6))


SQL_SIMILARITY = f"""{SQL_PAIR_VOCABULARY}, {sql_weights("cv_tokens", "cvw")}, {sql_weights("job_tokens", "jw")},
dots AS (SELECT a.doc_id, sum(c.w * j.w) AS s FROM apps a JOIN cvw c ON c.doc = a.doc_id
         JOIN jw j ON j.doc = a.item_id AND j.term = c.term GROUP BY 1),
sims AS (SELECT a.doc_id, a.item_id, round(coalesce(s, 0), 6) AS sim_cv_vaga
         FROM apps a LEFT JOIN dots USING (doc_id))"""


@query("cv_job_similarity", f"WITH {SQL_SIMILARITY} SELECT doc_id, item_id, sim_cv_vaga FROM sims")
def cv_job_similarity(spark: SparkSession, folder: str) -> DataFrame:
    pairs, docs, jobs = _pair_inputs(spark, folder)
    rows = tfidf.similarity(pairs, docs, jobs, "item_id", "doc_id")
    return rows.withColumn("sim_cv_vaga", F.round("sim_cv_vaga", 6))


@query(
    "best_candidates",
    f"""WITH {SQL_SIMILARITY}, ranked AS (SELECT *, row_number() OVER (
         PARTITION BY item_id ORDER BY sim_cv_vaga DESC, doc_id) AS rank FROM sims)
    SELECT item_id, doc_id, sim_cv_vaga, rank, CASE WHEN sim_cv_vaga >= 0.2::DOUBLE THEN 1 ELSE 0 END AS label
    FROM ranked WHERE rank <= 5""",
)
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: the five applications of every job whose text is closest to it."""
    sims = cv_job_similarity(spark, folder)
    best = ranking.top_k_per_group(sims, "item_id", "sim_cv_vaga", "doc_id", k=5, threshold=0.2)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


SQL_WORDS = """words_all AS (
  SELECT doc_id AS doc, 1 AS uses, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term
  FROM documents),
words AS (SELECT * FROM words_all)"""
SQL_BAG = f"""{SQL_WORDS}, {sql_vocabulary("words", "SELECT count(*) AS n FROM documents", 1000, 1, "n")}"""


def _bag_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = tfidf.spread_if_small(frames.table(spark, folder, "documents"))
    return docs.select("text", F.lit(1).alias("weight"))


@query("bow_vocab", f"WITH {SQL_BAG} SELECT term, df, tf, round(idf, 6) AS idf FROM vocab")
def bow_vocab(spark: SparkSession, folder: str) -> DataFrame:
    vocab = tfidf.vocabulary(_bag_texts(spark, folder), tfidf.BAG_OF_WORDS)
    return vocab.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query(
    "bow_vocab_baseline",
    f"""WITH {SQL_WORDS}, {sql_vocabulary("words", "SELECT count(*) AS n FROM documents", 15000, 3, "n")}
    SELECT term, df, tf, round(idf, 6) AS idf FROM vocab""",
)
def bow_vocab_baseline(spark: SparkSession, folder: str) -> DataFrame:
    vocab = tfidf.vocabulary(_bag_texts(spark, folder), tfidf.BASELINE_BAG)
    return vocab.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query(
    "bow_tfidf",
    f"""WITH {SQL_BAG}, {sql_weights("words", "bw")}
    SELECT doc AS doc_id, term, round(w, 6) AS w FROM bw""",
)
def bow_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    docs = frames.table(spark, folder, "documents")
    vocab = tfidf.vocabulary(_bag_texts(spark, folder), tfidf.BAG_OF_WORDS)
    rows = tfidf.weights(docs, "doc_id", vocab, tfidf.BAG_OF_WORDS)
    return rows.withColumn("w", F.round("w", 6))


@query(
    "bigram_vocab",
    f"""WITH s AS (SELECT doc_id, string_split({frames.sql_normalized("text")}, ' ') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM s),
    kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM w
             WHERE term <> '' AND term NOT IN {frames.SQL_STOP}),
    runs AS (SELECT doc_id AS doc, 1 AS uses, term FROM kept UNION ALL
             SELECT a.doc_id, 1, a.term || ' ' || b.term FROM kept a JOIN kept b
               ON a.doc_id = b.doc_id AND b.i = a.i + 1),
    {sql_vocabulary("runs", "SELECT count(*) AS n FROM documents", 2000, "0.01::DOUBLE * n", "0.5::DOUBLE * n")}
    SELECT term, df, tf, round(idf, 6) AS idf FROM vocab""",
)
def bigram_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Words and word pairs, with both document-frequency bounds as shares."""
    spec = tfidf.TfidfSpec(max_features=2000, min_df=0.01, max_df=0.5, ngram_min=1, ngram_max=2)
    vocab = tfidf.vocabulary(_bag_texts(spark, folder), spec)
    return vocab.select("term", "df", "tf", F.round("idf", 6).alias("idf"))
