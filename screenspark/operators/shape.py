"""Column selection, alignment and row cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.scalars import hiring_target, screening_target, stage, stage_outcome
from screenspark.names import col, cols
from screenspark.operators.profile import is_numeric

FeatureMap = Mapping[str, Sequence[str]]


def with_outcome(df: DataFrame, status: str = "situacao_candidato") -> DataFrame:
    """Lower-cased stage in place and its outcome as ``status_simplificado``."""
    return df.withColumn("status_simplificado", stage_outcome(col(status))).withColumn(
        status, stage(col(status))
    )


def without_first_stages(df: DataFrame, status: str = "situacao_candidato") -> DataFrame:
    """Drop people who only applied or were only proposed."""
    return df.filter(~stage(col(status)).isin(*fixed.FIRST_STAGES))


def screening_rows(df: DataFrame, outcome: str = "status_simplificado", out: str = "target_triagem") -> DataFrame:
    """Rows with a known outcome and the target: moved on or not."""
    known = df.filter(col(outcome) != fixed.OUTCOME_UNKNOWN)
    return known.withColumn(out, screening_target(col(outcome)))


def hiring_rows(df: DataFrame, outcome: str = "status_simplificado", out: str = "target_contratacao") -> DataFrame:
    """Rows of closed processes and the target: hired or not."""
    closed = df.filter(col(outcome).isin(*fixed.CLOSED_OUTCOMES))
    return closed.withColumn(out, hiring_target(col(outcome)))


def role_columns(feature_map: FeatureMap, roles: Sequence[str]) -> list[str]:
    return [c for r in roles for c in feature_map.get(r, [])]


def drop_roles(
    df: DataFrame, feature_map: FeatureMap, roles: Sequence[str] = tuple(fixed.DROPPED_ROLES)
) -> tuple[DataFrame, list[str]]:
    """Table without the columns of the roles, and the listed names it did not have."""
    listed = role_columns(feature_map, roles)
    absent = [c for c in listed if c not in df.columns]
    return df.select(*cols([c for c in df.columns if c not in set(listed)])), absent


def screening_table(
    df: DataFrame, feature_map: FeatureMap, status: str = "situacao_candidato"
) -> DataFrame:
    """Joined base to training base: outcome, row cleaning, target, column cleaning."""
    labelled = screening_rows(without_first_stages(with_outcome(df, status), status))
    return drop_roles(labelled, feature_map)[0]


def align(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns in order: absent ones null, unknown ones gone."""
    have = set(df.columns)
    return df.select(
        *[col(c) if c in have else F.lit(None).cast("string").alias(c) for c in expected]
    )


def align_map(features: Column, expected: Sequence[str]) -> list[Column]:
    """The expected entries of a feature map as columns."""
    return [F.try_element_at(features, F.lit(c)).alias(c) for c in expected]


def schema_warnings(
    features: Column, expected: Sequence[str], mode: str = "full", limit: int = fixed.WARNING_LIMIT
) -> dict[str, Column]:
    """What a row's feature map lacks or has too much.

    ``full`` lists up to ``limit`` names, ``summary`` counts all, ``off`` gives
    nothing. A key with a null value is present.
    """
    wanted = F.array(*[F.lit(c) for c in expected])
    missing = F.array_except(wanted, F.map_keys(features))
    unknown = F.array_except(F.map_keys(features), wanted)
    if mode == "full":
        return {"missing": F.slice(missing, 1, limit), "unknown": F.slice(unknown, 1, limit)}
    if mode == "summary":
        return {"missing_count": F.size(missing), "unknown_count": F.size(unknown)}
    if mode == "off":
        return {}
    raise ValueError(f"unknown warning mode: {mode}")


def groups_and_target(columns: Sequence[str], feature_map: FeatureMap) -> tuple[list[str], str]:
    """Group columns present, and the present target column of highest priority."""
    groups = [c for c in feature_map.get("group", fixed.GROUP_COLUMNS) if c in columns]
    targets = [c for c in feature_map.get("target", fixed.TARGET_PRIORITY) if c in columns]
    if not targets:
        raise ValueError(f"no target column; expected one of {fixed.TARGET_PRIORITY}")
    if not groups:
        raise ValueError(f"no group column; expected one of {fixed.GROUP_COLUMNS}")
    return groups, next((c for c in fixed.TARGET_PRIORITY if c in targets), targets[0])


def reorder(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Named columns to the front and to the back, the rest in between as they are."""
    ends = {*first, *last}
    return df.select(*cols([*first, *[c for c in df.columns if c not in ends], *last]))


@dataclass(frozen=True)
class FeatureKinds:
    """Which columns are numbers, categories and texts, and which are left out."""

    numbers: list[str]
    categories: list[str]
    texts: list[str]
    excluded: list[str]
    unmapped: list[str]

    def config(self, source: str, table: str) -> dict:
        return {
            "NUM_CANDIDATES": self.numbers,
            "CAT_CANDIDATES": self.categories,
            "TXT_CANDIDATES": self.texts,
            "EXCLUDE": self.excluded,
            "fallback_used": False,
            "params": {"source": source, "base_input": table},
        }


def classify_features(df: DataFrame, feature_map: FeatureMap, all_null: Sequence[str] = ()) -> FeatureKinds:
    """Kinds by the roles of a feature map; unlisted numeric columns are numbers.

    ``all_null`` names columns without any value: readers that infer types take
    them for numbers, so they count as numeric here.
    """
    have = set(df.columns)
    excluded = sorted(set(role_columns(feature_map, fixed.EXCLUDED_ROLES)) & have)
    categories = sorted(set(role_columns(feature_map, fixed.CATEGORY_ROLES)) & have)
    texts = sorted(set(feature_map.get("text", [])) & have)
    taken = {*excluded, *categories, *texts}
    numbers = sorted(c for c, k in df.dtypes if (is_numeric(k) or c in all_null) and c not in taken)
    return FeatureKinds(numbers, categories, texts, excluded, sorted(have - taken - set(numbers)))


def classify_by_type(df: DataFrame, feature_map: FeatureMap) -> FeatureKinds:
    """Fallback without named kinds: columns of no avoided role go by their type."""
    avoided_roles = ["id", "date", "text", "personal_info", "leakage_risk", "group"]
    avoided = set(role_columns(feature_map, avoided_roles))
    open_columns = [(c, k) for c, k in df.dtypes if c not in avoided]
    numbers = [c for c, k in open_columns if is_numeric(k)]
    others = [c for c, _ in open_columns if c not in numbers]
    return FeatureKinds(numbers, others, list(feature_map.get("text", [])), sorted(avoided), [])


def job_and_candidate_fields(meta: Mapping) -> tuple[list[str], list[str]]:
    """Model inputs that describe the job, and those that describe the candidate."""
    schema = meta.get("schema_in")
    if schema:
        names, texts = [*schema.get("cat", []), *schema.get("txt", [])], schema.get("txt", [])
    else:
        used = meta.get("features_used", {})
        names = [*used.get("num", []), *used.get("cat", []), *used.get("txt", [])]
        texts = used.get("txt", [])
    job = [c for c in texts if c.startswith("perfil_vaga.")]
    return job, [c for c in names if c not in job]
