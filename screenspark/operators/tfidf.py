"""TF-IDF vocabulary, weights and CV-to-job similarity on document tables.

Terms are counted inside each row, so the only shuffles are one row per
distinct term and task while fitting and one short vector per document while
weighting. The vocabulary has at most ``max_features`` rows and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.text import let, ngrams, plain_words, term_counts, tokens
from screenspark.names import col
from screenspark.operators.joins import hot_keys, skew_join
from screenspark.session import plan_bytes

# Spark's default input split.
SPLIT_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class TfidfSpec:
    """How to cut words and which terms to keep.

    ``min_df`` and ``max_df`` are document counts when whole numbers and shares
    of all documents when fractions; both bounds are inclusive. ``max_terms`` is
    the largest vocabulary that is taken: it is broadcast, at some 100 bytes a term.
    """

    max_features: int
    min_df: int | float = 1
    max_df: int | float = 1.0
    ngram_min: int = 1
    ngram_max: int = 1
    words: Callable[[Column], Column] = tokens
    max_terms: int = 200_000

    def __post_init__(self) -> None:
        if not 1 <= self.max_features <= self.max_terms:
            raise ValueError(f"max_features must lie in 1..{self.max_terms}")

    def terms(self, text: Column) -> Column:
        return ngrams(self.words(text), self.ngram_min, self.ngram_max)


# The similarity feature, the bag of words of the model, and the wider baseline one.
SIMILARITY = TfidfSpec(max_features=2000, min_df=3, max_df=0.9)
BAG_OF_WORDS = TfidfSpec(max_features=1000, words=plain_words)
BASELINE_BAG = TfidfSpec(max_features=15000, min_df=3, words=plain_words)


def spread_if_small(df: DataFrame) -> DataFrame:
    """Deal a small input out over all cores before heavy per-row text work.

    A small file is one split however many cores there are. Inputs that fill a
    default split per core are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan_bytes(df) >= cores * SPLIT_BYTES else df.repartition(cores)


def exploded(df: DataFrame, entries: Column, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` and one row ``t`` per entry; rows without an entry go.

    A plain explode makes the optimizer push "has entries" below the exchange that
    spreads the texts, so every text would be cut into terms twice, once of that in
    the few tasks of the scan. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(entries).alias("t")).filter(F.col("t").isNotNull())


def corpus(pairs: DataFrame, candidates: DataFrame, jobs: DataFrame, job: str, candidate: str) -> DataFrame:
    """Texts with the number of pairs they occur in: ``text``, ``weight``.

    Equals the candidate texts followed by the job texts of all pair rows, but
    every distinct text appears once, whatever number of pairs repeats it.
    """

    def side(table: DataFrame, key: str) -> DataFrame:
        uses = pairs.filter(col(key).isNotNull()).groupBy(col(key)).agg(F.count("*").alias("weight"))
        return spread_if_small(table).join(uses, key).select("text", "weight")

    return side(candidates, candidate).unionByName(side(jobs, job))


def term_statistics(texts: DataFrame, spec: TfidfSpec) -> DataFrame:
    """Document frequency and total count of every term, weighted by text uses."""
    counted = exploded(texts, term_counts(spec.terms(F.col("text"))), "weight")
    return counted.groupBy(F.col("t.term").alias("term")).agg(
        F.sum("weight").alias("df"), F.sum(F.col("weight") * F.col("t.tf")).alias("tf")
    )


def vocabulary(texts: DataFrame, spec: TfidfSpec, n_docs: Column | None = None) -> DataFrame:
    """Kept terms: ``term``, ``df``, ``tf``, ``idf`` and ``pos``, the alphabetical index.

    Terms outside the document-frequency bounds go first, then the most counted
    ``max_features`` stay, ties by term. ``n_docs`` counts the documents where
    ``texts`` does not hold them all, such as absent ones.
    """
    if n_docs is None:
        n_docs = texts.agg(F.coalesce(F.sum("weight"), F.lit(0))).scalar()
    return _kept_terms(term_statistics(texts, spec), spec, n_docs)


def _kept_terms(statistics: DataFrame, spec: TfidfSpec, n_docs: Column) -> DataFrame:

    def bound(value: int | float) -> Column:
        return F.lit(value) if isinstance(value, int) else F.lit(value) * n_docs

    kept = statistics.filter(
        (F.col("df") >= bound(spec.min_df)) & (F.col("df") <= bound(spec.max_df))
    )
    top = kept.orderBy(F.desc("tf"), F.asc("term")).limit(spec.max_features)
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    # At most max_features rows reach this window.
    place = F.row_number().over(Window.orderBy("term")) - 1
    return top.select("term", "df", "tf", idf.alias("idf"), place.alias("pos"))


def vectors(docs: DataFrame, key: str, vocab: DataFrame, spec: TfidfSpec) -> DataFrame:
    """L2-normalised rows: ``key`` and ``vec``, position-ordered ``(pos, term, w)``.

    Documents without a known term have no row. A vector is never longer than
    the vocabulary.
    """
    counted = exploded(spread_if_small(docs), term_counts(spec.terms(F.col("text"))), col(key))
    weighted = counted.join(F.broadcast(vocab.select("term", "idf", "pos")), F.col("t.term") == F.col("term"))
    entry = F.struct("pos", "term", (F.col("t.tf") * F.col("idf")).alias("w"))
    rows = weighted.groupBy(col(key)).agg(F.sort_array(F.collect_list(entry)).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))

    def unit(length: Column) -> Column:
        return F.transform(
            "raw",
            lambda e: F.struct(
                e["pos"].alias("pos"), e["term"].alias("term"), (e["w"] / length).alias("w")
            ),
        )

    return rows.select(col(key), let(norm, unit).alias("vec"))


def weights(docs: DataFrame, key: str, vocab: DataFrame, spec: TfidfSpec) -> DataFrame:
    """Long form of the vectors: ``key``, ``term``, ``w``."""
    return vectors(docs, key, vocab, spec).select(col(key), F.inline("vec")).select(col(key), "term", "w")


def _dense(vec: Column) -> Column:
    """Array with the weight at every position up to the vector's last term."""

    def gap(v: Column, e: Column, i: Column) -> Column:
        earlier = F.when(i == 0, F.lit(-1)).otherwise(F.get(v, i - 1)["pos"])
        return F.array_repeat(F.lit(0.0), (e["pos"] - earlier - 1).cast("int"))

    def spread(v: Column) -> Column:
        return F.flatten(F.transform(v, lambda e, i: F.concat(gap(v, e, i), F.array(e["w"]))))

    return let(vec, spread)


def term_table(table: DataFrame, key: str, spec: TfidfSpec) -> DataFrame:
    """``key, counts``: every text as its distinct terms with their counts."""
    return spread_if_small(table).select(col(key), term_counts(spec.terms(F.col("text"))).alias("counts"))


def pair_vocabulary(
    pairs: DataFrame, candidates: DataFrame, jobs: DataFrame, job: str, candidate: str, spec: TfidfSpec = SIMILARITY
) -> DataFrame:
    """Vocabulary of both texts of every pair; an absent text counts as an empty one.

    Terms are counted in the row before the number of uses is joined, so no text
    is shuffled.
    """

    def side(table: DataFrame, key: str) -> DataFrame:
        uses = pairs.filter(col(key).isNotNull()).groupBy(col(key)).agg(F.count("*").alias("weight"))
        terms = exploded(term_table(table, key, spec).join(uses, key), F.col("counts"), "weight")
        return terms.groupBy(F.col("t.term").alias("term")).agg(
            F.sum("weight").alias("df"), F.sum(F.col("weight") * F.col("t.tf")).alias("tf")
        )

    both = side(candidates, candidate).unionByName(side(jobs, job))
    statistics = both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    return _kept_terms(statistics, spec, pairs.agg(2 * F.count("*")).scalar())


def similarity(
    pairs: DataFrame,
    candidates: DataFrame,
    jobs: DataFrame,
    job: str,
    candidate: str,
    spec: TfidfSpec = SIMILARITY,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Cosine of candidate and job text for every pair row, as ``sim_cv_vaga``.

    Every text is vectorised once, however many pairs use it. The job vector is
    laid out dense, so the product walks the candidate's terms once. Pairs
    without a shared term, or without a text, get 0.
    """
    if vocab is None:
        vocab = pair_vocabulary(pairs, candidates, jobs, job, candidate, spec)
    cand_vec = vectors(candidates, candidate, vocab, spec).withColumnRenamed("vec", "cand_vec")
    job_vec = vectors(jobs, job, vocab, spec).select(col(job), _dense(F.col("vec")).alias("job_vec"))
    with_cand = skew_join(pairs, cand_vec, candidate, "left")
    both = skew_join(with_cand, job_vec, job, "left", hot_keys(pairs, job))
    product = F.aggregate(
        "cand_vec",
        F.lit(0.0),
        lambda s, e: s + e["w"] * F.coalesce(F.get(F.col("job_vec"), e["pos"].cast("int")), F.lit(0.0)),
    )
    return both.withColumn("sim_cv_vaga", F.coalesce(product, F.lit(0.0))).drop("cand_vec", "job_vec")
