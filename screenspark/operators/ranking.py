"""Top-k, first-row and ordering operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.scalars import normalized_id, threshold_label
from screenspark.names import col, cols, free_name, hashable
from screenspark.session import parallelism

def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str, most: int = fixed.TOP_K_MAX
) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, numbered from 1 in ``out``.

    ``n`` is at most ``most``. Slices of a key are cut to ``n`` rows first, so even
    a key with a third of all rows meets in one task with ``n`` rows per slice
    only. ``order`` must be total, or the choice is open.
    """
    if not 1 <= n <= most:
        raise ValueError(f"n must lie in 1..{most}")
    salt = F.pmod(F.xxhash64(*cols(hashable(df))), F.lit(parallelism(df.sparkSession)))
    sliced = F.row_number().over(Window.partitionBy(*cols(keys), salt).orderBy(*order))
    df = df.withColumn(out, sliced).filter(col(out) <= n).drop(out)
    place = F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order))
    return df.withColumn(out, place).filter(col(out) <= n)


def top_k_per_group(
    df: DataFrame,
    group: str,
    score: str,
    position: str,
    k: int = fixed.TOP_K,
    threshold: float = fixed.THRESHOLD,
) -> DataFrame:
    """The ``k`` best-scored rows per group with rank and threshold label.

    Equal scores keep their order in ``position``.
    """
    best = first_rows(df, [group], [col(score).desc(), col(position).asc()], k, "rank")
    return best.withColumn("label", threshold_label(col(score), threshold))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Deduplicate: the first row of every key by ``order``."""
    place = free_name(df, "place")
    return first_rows(df, keys, order, 1, place).drop(place)


def dedupe_candidates(
    df: DataFrame,
    position: str,
    job_key: str = fixed.JOB_KEYS[0],
    hint: str | None = None,
    text_key: str = fixed.CANDIDATE_CV,
) -> DataFrame:
    """One row per job and candidate, the first by ``position``.

    Without any candidate id column the CV text tells candidates apart.
    """
    candidate = candidate_column(df, hint)
    key = candidate or (text_key if text_key in df.columns else df.columns[0])
    if key != text_key:
        return first_per_key(df, [job_key, key], [col(position).asc()])
    # Texts are told apart by their digest, which is what gets sorted.
    digest = free_name(df, "digest")
    keyed = df.withColumn(digest, F.sha2(col(key).cast("binary"), 256))
    return first_per_key(keyed, [job_key, digest], [col(position).asc()]).drop(digest)


def candidate_column(df: DataFrame, hint: str | None = None) -> str | None:
    if hint in df.columns:
        return hint
    return next((c for c in fixed.CANDIDATE_KEYS if c in df.columns), None)


def group_fields(df: DataFrame, group: str, position: str, names: Sequence[str]) -> DataFrame:
    """Per group the named fields of its first row by ``position``."""
    first = F.min_by(F.struct(*cols(names)), col(position)).alias("first")
    return df.groupBy(col(group)).agg(first).select(
        col(group), *[F.col("first")[n].alias(n) for n in names]
    )


def sample_keys(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    """The ``n`` smallest distinct ids, shown when an id is not found."""
    ids = df.filter(col(key).isNotNull()).select(normalized_id(col(key)).alias(key)).distinct()
    return ids.orderBy(col(key)).limit(n)


def require_job(df: DataFrame, key: str, job_id: str) -> DataFrame:
    """Rows of one job, or an error that names some existing ids."""
    wanted = df.filter(normalized_id(col(key)) == normalized_id(F.lit(job_id)))
    if wanted.isEmpty():
        known = [r[0] for r in sample_keys(df, key).collect()]
        raise ValueError(f"no rows for {key}={job_id}; existing ids: {known}")
    return wanted
