"""Batch prediction and ranking of candidates for many jobs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.scalars import read_number
from screenspark.names import col, with_ml_names
from screenspark.operators.joins import job_candidate_features
from screenspark.operators.models import ScreeningModel, with_probability
from screenspark.operators.profile import score_summary
from screenspark.operators.ranking import top_k_per_group
from screenspark.operators.shape import align_map, schema_warnings


def predict(
    df: DataFrame,
    model: ScreeningModel,
    features: str = "features",
    threshold: float | None = None,
    warnings: str = "off",
) -> DataFrame:
    """Score rows whose inputs are a string map; other columns pass through.

    Missing inputs are empty, unknown ones ignored; ``warnings`` adds what was
    missing or unknown. Without ``threshold`` the model's own decides. The same
    code serves tables and streams.
    """
    threshold = model.threshold if threshold is None else threshold
    inputs = model.columns.inputs()
    others = [c for c in df.columns if c != features]
    notes = schema_warnings(col(features), inputs, warnings)
    numbers = set(model.columns.numbers)
    given = [
        F.coalesce(read_number(column), F.lit(0.0)).alias(c) if c in numbers else column
        for c, column in zip(inputs, align_map(col(features), inputs), strict=True)
    ]
    wide = df.select(
        F.struct(*[col(c) for c in others], *[n.alias(k) for k, n in notes.items()]).alias("passed"), *given
    )
    scored = with_probability(model.pipeline, with_ml_names(wide), threshold, "prob_next_phase")
    return scored.select(
        "passed.*",
        "prob_next_phase",
        F.col("y_pred").alias("label"),
        F.lit(float(threshold)).alias("threshold"),
    )


def require_candidates(requests: DataFrame, candidates: str = "candidatos") -> DataFrame:
    """Requests with candidates; an error if any request has none."""
    empty = requests.filter(F.coalesce(F.size(col(candidates)), F.lit(0)) <= 0)
    if not empty.isEmpty():
        raise ValueError(fixed.NO_CANDIDATES)
    return requests


def request_pairs(requests: DataFrame, job_key: str) -> DataFrame:
    """Ranking requests with nested candidates as one row per candidate."""
    each = require_candidates(requests).select(col(job_key), F.posexplode("candidatos").alias("pos", "c"))
    return each.select(
        col(job_key),
        "pos",
        F.try_element_at("c.meta", F.lit("external_id")).alias("external_id"),
        F.col("c.candidato").alias("candidate_features"),
    )


def score_pairs(
    pairs: DataFrame,
    jobs: DataFrame,
    model: ScreeningModel,
    job_key: str,
    threshold: float | None = None,
    warnings: str = "off",
) -> DataFrame:
    """Probability of every (job, candidate) pair; the candidate's inputs win."""
    merged = job_candidate_features(pairs, jobs, job_key, "job_features", "candidate_features")
    return predict(
        merged.drop("job_features", "candidate_features"), model, threshold=threshold, warnings=warnings
    )


def rank_candidates(
    pairs: DataFrame,
    jobs: DataFrame,
    model: ScreeningModel,
    job_key: str,
    position: str,
    top_k: int = fixed.TOP_K,
    threshold: float | None = None,
    warnings: str = "off",
) -> tuple[DataFrame, DataFrame]:
    """The best candidates of every job, and a score summary per job.

    The best rows carry ``top_k`` and ``threshold_used``.
    """
    used = model.threshold if threshold is None else threshold
    scored = score_pairs(pairs, jobs, model, job_key, used, warnings).drop("label", "threshold")
    best = top_k_per_group(scored, job_key, "prob_next_phase", position, top_k, used)
    best = best.withColumns({"top_k": F.lit(top_k), "threshold_used": F.lit(float(used))})
    return best, score_summary(scored, job_key, "prob_next_phase")
