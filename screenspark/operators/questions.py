"""Interview-prompt text per job and clean-up of generated replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.text import json_block, truncated
from screenspark.names import col

REPLY_SCHEMA = "struct<common_questions:array<string>,per_candidate:map<string,array<string>>>"


def _filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(""))


def prompt_texts(
    ranked: DataFrame,
    jobs: DataFrame,
    job_key: str,
    candidate_id: str,
    cv: str,
    rank: str,
    limit: int = fixed.PROMPT_CHARS,
) -> DataFrame:
    """One prompt per job from the ranked (already cut) candidates and the job fields.

    ``jobs`` holds ``descricao``, ``requisitos`` and ``atividades`` as texts. Each
    candidate keeps the CV that belongs to its id.
    """
    line = F.concat(
        F.lit("- id="),
        F.coalesce(col(candidate_id).cast("string"), F.lit(fixed.NO_ID)),
        F.lit(": "),
        truncated(col(cv), limit),
    )
    place = F.when(
        col(rank) > fixed.TOP_K_MAX, F.raise_error(F.lit("cut the candidates of a job before building its prompt"))
    ).otherwise(col(rank))
    lines = ranked.groupBy(col(job_key)).agg(
        F.sort_array(F.collect_list(F.struct(place.cast("int").alias("rank"), line.alias("line")))).alias("lines")
    )
    people = F.transform("lines", lambda x: x["line"])
    duties = truncated(F.col("atividades"), limit)
    parts = F.concat(
        F.array(*[F.lit(x) for x in fixed.PROMPT_HEAD]),
        F.array(
            F.concat(F.lit("Descricao: "), truncated(F.col("descricao"), limit)),
            F.concat(F.lit("Requisitos: "), truncated(F.col("requisitos"), limit)),
        ),
        F.when(duties != "", F.array(F.concat(F.lit("Atividades: "), duties))).otherwise(
            F.array().cast("array<string>")
        ),
        F.array(F.lit(""), F.lit("CANDIDATOS:")),
        people,
        F.array(F.lit(""), F.lit(fixed.PROMPT_TAIL)),
    )
    return lines.join(jobs, job_key).select(
        col(job_key), F.size("lines").alias("n_candidates"), F.array_join(parts, "\n").alias("prompt")
    )


def prompt_fields(jobs: DataFrame, job_key: str) -> DataFrame:
    """Description, requirements and duties of a job, with their fallback columns."""

    def field(name: str) -> Column:
        return col(name) if name in jobs.columns else F.lit("")

    return jobs.select(
        col(job_key),
        _filled(field(fixed.JOB_ACTIVITIES), field("descricao")).alias("descricao"),
        _filled(field(fixed.JOB_SKILLS), field("requisitos")).alias("requisitos"),
        _filled(field(fixed.JOB_ACTIVITIES), field("atividades")).alias("atividades"),
    )


def normalized_reply(
    reply: Column,
    requested: Column,
    n_common: int = fixed.COMMON_QUESTIONS,
    n_each: int = fixed.CANDIDATE_QUESTIONS,
) -> tuple[Column, Column]:
    """Common questions and questions per requested id from a free-text reply.

    ``requested`` is an array of ids. Unreadable replies and absent ids give
    empty lists, ids nobody asked for are dropped, lists are cut to size. An id
    that is asked for twice is one entry, as are all missing ids.
    """
    data = F.from_json(json_block(F.coalesce(reply, F.lit(""))), REPLY_SCHEMA)
    none = F.array().cast("array<string>")
    common = F.slice(F.coalesce(data["common_questions"], none), 1, n_common)
    ids = F.array_distinct(F.transform(requested, lambda i: F.coalesce(i, F.lit(fixed.NO_ID))))
    known = F.coalesce(data["per_candidate"], F.map_from_arrays(none, F.array().cast("array<array<string>>")))
    lists = F.transform(
        ids, lambda i: F.slice(F.coalesce(F.try_element_at(known, i), none), 1, n_each)
    )
    return common, F.map_from_arrays(ids, lists)
