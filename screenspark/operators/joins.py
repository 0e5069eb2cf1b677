"""Equi joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import merged_maps
from screenspark.names import col, cols, free_name, hashable
from screenspark.session import broadcast_limit, parallelism, plan_bytes


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that hold more rows than one shuffle partition's fair share.

    Each such key comes with ``slices``, the number of fair shares it fills.
    At most ``partitions`` keys can exceed one share, so the result is small by
    construction and safe to broadcast.
    """
    partitions = parallelism(df.sparkSession)
    keyed = df.select(col(key).alias("hot_key")).filter("hot_key is not null")
    total = keyed.agg(F.count("*")).scalar()
    return (
        keyed.groupBy("hot_key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") * partitions > total)
        .select("hot_key", F.ceil(F.col("n") * partitions / total).cast("int").alias("slices"))
    )


def skew_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` on ``key`` (``how`` is inner or left).

    Rows of a hot key on the ``many`` side are dealt out over its slices by a
    hash of the row, and the matching ``one`` rows are copied once per
    slice; the copies add up to at most two rows per shuffle partition for a
    unique key. Rows without a key cannot match and are dealt out as well. When
    Spark's estimate of ``one`` is within its broadcast limit the plain join does
    not shuffle ``many`` at all, and no key can be hot.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if plan_bytes(one) <= broadcast_limit(one.sparkSession):
        return many.join(one, key, how)
    hot = hot_keys(many, key) if hot is None else hot
    partitions = parallelism(many.sparkSession)
    salt, slices = free_name(many, "salt"), "slices"
    spread = F.xxhash64(*cols(hashable(many)))
    dealt = (
        many.join(F.broadcast(hot), col(key) == F.col("hot_key"), "left")
        .withColumn(
            salt,
            F.when(col(key).isNull(), F.pmod(spread, F.lit(partitions)))
            .when(F.col(slices) > 1, F.pmod(spread, F.col(slices)))
            .otherwise(F.lit(0))
            .cast("int"),
        )
        .drop("hot_key", slices)
    )
    copied = (
        one.join(F.broadcast(hot), col(key) == F.col("hot_key"), "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(slices), F.lit(1)) - 1)))
        .drop("hot_key", slices)
    )
    return dealt.join(copied, [key, salt], how).drop(salt)


def left_join_many(
    one: DataFrame, many: DataFrame, key: str, hot: DataFrame | None = None
) -> DataFrame:
    """``one`` left join ``many`` where the right side is the large, skewed one.

    A left outer join cannot split its right side, so matched pairs come from a
    balanced inner join and unmatched ``one`` rows from an anti join against the
    distinct keys.
    """
    order = one.columns + [c for c in many.columns if c != key]
    matched = skew_join(many, one, key, "inner", hot).select(*cols(order))
    keys = many.select(col(key)).distinct()
    alone = one.join(keys, key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True).select(*cols(order))


def _with_suffix(df: DataFrame, names: set[str], suffix: str) -> DataFrame:
    return df.select(*[col(c).alias(c + suffix if c in names else c) for c in df.columns])


def join_screening_tables(
    jobs: DataFrame,
    prospects: DataFrame,
    applicants: DataFrame,
    job_key: str = "codigo_vaga",
    applicant_key: str = "codigo_applicant",
) -> DataFrame:
    """jobs left join prospects left join applicants, with one title and one modality.

    Applicants are attached to the prospect rows first: a job without prospects
    has no applicant either, so the result is the same and both balanced joins
    read the prospect table directly. Columns an applicant shares with the other
    two tables get the suffix ``_applicant``; of a modality on both job and
    prospect the job's stays, and ``titulo_vaga`` replaces the job's ``titulo``.
    """
    left_names = (set(jobs.columns) | set(prospects.columns)) - {applicant_key}
    right = _with_suffix(applicants, left_names & set(applicants.columns), "_applicant")
    if "titulo_vaga" in set(jobs.columns) | set(prospects.columns):
        jobs = jobs.drop("titulo")
    shared = (set(jobs.columns) & set(prospects.columns)) - {job_key}
    slim = prospects.drop("modalidade") if "modalidade" in shared else prospects
    jobs = _with_suffix(jobs, shared - {"modalidade"}, "_x")
    slim = _with_suffix(slim, shared - {"modalidade"}, "_y")
    enriched = skew_join(slim, right, applicant_key, "left")
    joined = left_join_many(jobs, enriched, job_key, hot_keys(prospects, job_key))
    return joined.withColumnRenamed("titulo_vaga", "titulo")


def left_join_counts(base: DataFrame, extra: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Left join of two per-key aggregates; keys absent on the right count 0."""
    joined = base.join(extra, key, "left")
    zero = {c: F.coalesce(col(c), F.lit(0)).cast("bigint") for c in counts}
    return joined.withColumns(zero)


def job_candidate_features(
    pairs: DataFrame,
    jobs: DataFrame,
    key: str,
    job_features: str,
    candidate_features: str,
    out: str = "features",
) -> DataFrame:
    """Feature map of every (job, candidate) pair; the candidate's entry wins.

    A pair whose job has no row keeps the candidate's fields alone.
    """
    joined = skew_join(pairs, jobs, key, "left")
    return joined.withColumn(out, merged_maps(col(job_features), col(candidate_features)))


def aligned_counts(
    ref: DataFrame,
    prod: DataFrame,
    names: Sequence[str],
    key: Callable[[Column], Column] = lambda value: value,
) -> DataFrame:
    """Value counts of both tables side by side: feature, value, ref_c, prod_c.

    One tagged union and one aggregation stand in for the outer join of two
    count tables; nulls are not a value. ``key`` may shorten the values.
    """

    def long(df: DataFrame, side: Column) -> DataFrame:
        texts = df.select(*[col(c).cast("string").alias(c) for c in names])
        return texts.unpivot([], cols(names), "feature", "value").withColumn("is_ref", side)

    both = long(ref, F.lit(1)).unionByName(long(prod, F.lit(0))).filter("value is not null")
    both = both.withColumn("value", key(F.col("value")))
    return both.groupBy("feature", "value").agg(
        F.sum("is_ref").alias("ref_c"), F.sum(1 - F.col("is_ref")).alias("prod_c")
    )


