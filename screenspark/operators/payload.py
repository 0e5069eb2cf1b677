"""Ranking requests: job fields with their candidates as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import compact_json, normalized_id
from screenspark.names import col, cols
from screenspark.operators.joins import skew_join
from screenspark.operators.ranking import (
    candidate_column,
    dedupe_candidates,
    first_rows,
    group_fields,
)


def candidate_rows(
    df: DataFrame,
    position: str,
    candidate_fields: Sequence[str],
    job_key: str = "codigo_vaga",
    hint: str | None = None,
) -> DataFrame:
    """One row per job and distinct candidate with its id and field JSON.

    Works for any number of candidates; ``candidate_payload`` is the JSON object
    of one candidate. ``place_key`` orders the candidates of a job.
    """
    key = candidate_column(df, hint)
    unique = dedupe_candidates(df.withColumn(job_key, normalized_id(col(job_key))), position, job_key, hint)
    external = normalized_id(col(key)) if key else col(position).cast("string")
    order = col(key) if key else col(position)
    present = [f for f in candidate_fields if f in df.columns]
    meta = F.to_json(F.struct(external.alias("external_id")))
    return unique.select(
        col(job_key),
        order.alias("place_key"),
        external.alias("external_id"),
        F.concat(
            F.lit('{"meta":'), meta, F.lit(',"candidato":'), compact_json(unique, present), F.lit("}")
        ).alias("candidate_payload"),
    )


def job_rows(df: DataFrame, position: str, job_fields: Sequence[str], job_key: str = "codigo_vaga") -> DataFrame:
    """Per job the JSON of the job fields, taken from its first row."""
    present = [f for f in job_fields if f in df.columns]
    keyed = df.withColumn(job_key, normalized_id(col(job_key)))
    if not present:
        return keyed.select(col(job_key), F.lit("{}").alias("job_payload")).distinct()
    texts = keyed.select(
        col(job_key), col(position), *[col(f).cast("string").alias(f) for f in present]
    )
    first = group_fields(texts, job_key, position, present)
    return first.select(col(job_key), F.to_json(F.struct(*cols(present))).alias("job_payload"))


def job_payloads(
    df: DataFrame,
    position: str,
    job_fields: Sequence[str],
    candidate_fields: Sequence[str],
    top_n: int,
    job_key: str = "codigo_vaga",
    hint: str | None = None,
) -> DataFrame:
    """One request document per job with its first ``top_n`` candidates.

    The cut (at most 1000) comes before the candidates are gathered. Without a
    cut use ``candidate_rows`` and ``job_rows``: their join is whole however
    many candidates a job has, but it does not squeeze them into one document.
    """
    rows = candidate_rows(df, position, candidate_fields, job_key, hint)
    best = first_rows(rows, [job_key], [F.col("place_key")], top_n, "place")
    lists = best.groupBy(col(job_key)).agg(
        F.sort_array(F.collect_list(F.struct("place", "candidate_payload"))).alias("items")
    )
    joined = lists.join(job_rows(df, position, job_fields, job_key), job_key)
    people = F.array_join(F.transform("items", lambda i: i["candidate_payload"]), ",")
    return joined.select(
        col(job_key),
        F.size("items").alias("n_candidates"),
        F.concat(
            F.lit('{"vaga":'), "job_payload", F.lit(',"candidatos":['), people, F.lit("]}")
        ).alias("payload"),
    )


def payload_rows(
    df: DataFrame,
    position: str,
    job_fields: Sequence[str],
    candidate_fields: Sequence[str],
    job_key: str = "codigo_vaga",
    hint: str | None = None,
) -> DataFrame:
    """Uncut form: every candidate in a row of its own beside the job's JSON."""
    people = candidate_rows(df, position, candidate_fields, job_key, hint)
    return skew_join(people, job_rows(df, position, job_fields, job_key), job_key)
