"""Column profiles, counts, rates and distributions.

Profiles of many columns go through one ``unpivot`` and a two-level aggregation
(value, then column). A distinct count per column in one ``agg`` would copy
every row once per column through the shuffle instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.scalars import known_number
from screenspark.names import col, cols
from screenspark.operators.prefix import number_counts, quantiles_of

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Longer values are told apart by their digest, so whole texts need not be shuffled.
DIGEST_FROM = 64


def value_key(value: Column) -> Column:
    """The value itself, or the digest of a long one."""
    digest = F.sha2(value.cast("binary"), 256)
    return F.when(F.char_length(value) > DIGEST_FROM, digest).otherwise(value)


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Counts per non-null value, largest first, ties by value."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name)).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), col(name).asc())


def value_shares(df: DataFrame, name: str) -> DataFrame:
    """Percentage of each non-null value among the non-null rows."""
    total = df.agg(F.count(col(name))).scalar()
    return value_counts(df, name).select(col(name), (F.col("n") * 100.0 / total).alias("pct"))


def distinct_per_group(df: DataFrame, group: str, member: str, out: str) -> DataFrame:
    """Distinct non-null members per non-null group."""
    pairs = df.filter(col(group).isNotNull())
    return pairs.groupBy(col(group)).agg(F.countDistinct(col(member)).alias(out))


def count_of_counts(counts: DataFrame, name: str, top: int | None = 10) -> DataFrame:
    """How often each count occurs; the ``top`` most frequent, ties by count."""
    spread = counts.groupBy(col(name)).agg(F.count("*").alias("n_groups"))
    ordered = spread.orderBy(F.desc("n_groups"), col(name).asc())
    return ordered if top is None else ordered.limit(top)


def hire_rates(df: DataFrame, group: str, member: str, hired: Column) -> DataFrame:
    """Distinct candidates, distinct hired ones and their rate per job.

    Reducing to one row per (job, candidate) first makes both distinct counts
    plain sums, and a hot job is spread over its candidates.
    """
    people = (
        df.filter(col(group).isNotNull() & col(member).isNotNull())
        .groupBy(col(group), col(member))
        .agg(F.max(hired.cast("int")).alias("hired"))
    )
    jobs = people.groupBy(col(group)).agg(
        F.count("*").alias("n_candidatos"),
        F.coalesce(F.sum("hired"), F.lit(0)).alias("n_contratados"),
    )
    return jobs.withColumn("taxa_contratacao", F.col("n_contratados") / F.col("n_candidatos"))


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max; one row per column."""
    counts = number_counts(df, names)
    times = F.when(F.col("v").isNotNull(), F.col("n"))
    sizes = counts.groupBy("feature").agg(
        F.coalesce(F.sum(times), F.lit(0)).alias("count"),
        (F.sum(F.col("v") * F.col("n")) / F.sum(times)).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    # One row per column: the broadcasts are as small as the column list.
    apart = F.col("n") * (F.col("v") - F.col("mean")) ** 2
    spread = F.when(F.col("count") > 1, F.sqrt(F.col("apart") / (F.col("count") - 1)))
    moments = (
        counts.join(F.broadcast(sizes), "feature")
        .groupBy("feature", "count", "mean", "min", "max")
        .agg(F.sum(apart).alias("apart"))
        .select("feature", "count", "mean", spread.alias("std"), "min", "max")
    )
    quarters = quantiles_of(counts, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(F.broadcast(quarters), "feature", "left")


def _long_form(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return value_texts(df, names).unpivot([], cols(names), "feature", "value")


def value_text(df: DataFrame, name: str) -> Column:
    """The column as text; NaN is missing and so null."""
    kind = dict(df.dtypes)[name]
    value = F.nanvl(col(name), F.lit(None)) if kind in ("float", "double") else col(name)
    return value.cast("string").alias(name)


def value_texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns as text."""
    return df.select(*[value_text(df, n) for n in names])


def _value_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (column, distinct value): its key, head, text length and row count."""
    value = F.col("value")
    return (
        _long_form(df, names)
        .select(
            "feature",
            value_key(value).alias("key"),
            F.substring("value", 1, DIGEST_FROM).alias("head"),
            F.char_length("value").alias("length"),
        )
        .groupBy("feature", "key", "head", "length")
        .agg(F.count("*").alias("n"))
    )


def missing_and_cardinality(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls and number of distinct non-null values per column."""
    values = _value_table(df, df.columns if names is None else names)
    return values.groupBy("feature").agg(
        (F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"),
        F.count("key").alias("nunique"),
    )


def most_missing(profile: DataFrame, top: int = 30) -> DataFrame:
    return profile.select("feature", "missing_rate").orderBy(F.desc("missing_rate"), "feature").limit(top)


def most_varied(profile: DataFrame, top: int = 20) -> DataFrame:
    return profile.select("feature", "nunique").orderBy(F.desc("nunique"), "feature").limit(top)


def least_varied(profile: DataFrame, top: int = 20) -> DataFrame:
    return profile.select("feature", "nunique").orderBy(F.asc("nunique"), F.desc("feature")).limit(top)


# A string column is text when its mean length is above this; a null counts 3.
TEXT_LENGTH = 50
NULL_LENGTH = 3


def column_profile(df: DataFrame) -> DataFrame:
    """Kind, missing rate (3 digits) and distinct values per column.

    Kind is numeric, datetime, text or categorical. An all-null column is
    numeric, as a reader that infers types from values would have it.
    """
    kinds = dict(df.dtypes)
    declared = F.create_map(
        *[
            F.lit(x)
            for name, kind in kinds.items()
            for x in (
                name,
                "numeric" if is_numeric(kind) or kind == "boolean"
                else "datetime" if kind in ("date", "timestamp", "timestamp_ntz")
                else "string",
            )
        ]
    )
    rows = F.sum("n")
    stats = _value_table(df, df.columns).groupBy("feature").agg(
        F.round(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)) / rows, 3).alias("missing_rate"),
        F.count("key").alias("nunique"),
        (F.sum(F.coalesce("length", F.lit(NULL_LENGTH)) * F.col("n")) / rows).alias("mean_length"),
    )
    kind = F.element_at(declared, F.col("feature"))
    return stats.select(
        F.col("feature").alias("coluna"),
        F.when(F.col("nunique") == 0, "numeric")
        .when(kind != "string", kind)
        .when(F.col("mean_length") > TEXT_LENGTH, "text")
        .otherwise("categorical")
        .alias("tipo"),
        "missing_rate",
        "nunique",
    )


def sorted_profile(profile: DataFrame) -> DataFrame:
    return profile.orderBy("tipo", F.desc("missing_rate"), F.desc("nunique"), "coluna")


def _smallest_values(df: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest distinct values per column, without shuffling whole texts.

    A smaller value never has a larger head, so the wanted values are among the
    rows whose head is at most the n-th smallest head of their column.
    """

    def smallest(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("feature").orderBy(name))
        distinct = rows.filter(F.col(name).isNotNull()).select("feature", name).distinct()
        return distinct.withColumn("place", place).filter(F.col("place") <= n)

    # One bound per column.
    bounds = smallest(values, "head").groupBy(F.col("feature").alias("b_feature")).agg(
        F.max("head").alias("bound")
    )
    near = _long_form(df, df.columns).join(
        F.broadcast(bounds),
        (F.col("feature") == F.col("b_feature")) & (F.substring("value", 1, DIGEST_FROM) <= F.col("bound")),
    )
    return smallest(near, "value")


def column_audit(df: DataFrame, examples: int = 5) -> DataFrame:
    """Type, distinct values, missing ratio (4 digits) and some example values per column.

    The examples are the smallest distinct values as text; "first seen" has no
    meaning in a distributed table. They are cut to ``examples`` per column
    before they are collected.
    """
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    values = _value_table(df, df.columns)
    stats = values.groupBy("feature").agg(
        F.count("key").alias("n_unique"),
        F.round(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias(
            "missing_ratio"
        ),
    )
    shown = (
        _smallest_values(df, values, examples)
        .groupBy("feature")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("exemplos"))
    )
    return stats.join(F.broadcast(shown), "feature", "left").select(
        F.col("feature").alias("coluna"),
        F.element_at(kinds, F.col("feature")).alias("dtype"),
        "n_unique",
        "missing_ratio",
        F.coalesce("exemplos", F.lit("")).alias("exemplos"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Negatives, positives, the weight ``neg / max(1, pos)`` and the target rate."""
    counts = df.agg(
        F.coalesce(F.sum(F.when(col(target) == 0, 1)), F.lit(0)).alias("neg"),
        F.coalesce(F.sum(F.when(col(target) == 1, 1)), F.lit(0)).alias("pos"),
        F.round(F.avg(col(target)), 3).alias("target_rate"),
    )
    return counts.withColumn("scale_pos_weight", F.col("neg") / F.greatest(F.lit(1), F.col("pos")))


def score_summary(df: DataFrame, group: str, score: str) -> DataFrame:
    """Number of candidates and mean, smallest and largest score per job."""
    return df.groupBy(col(group)).agg(
        F.count("*").alias("n_candidates"),
        F.avg(col(score)).alias("prob_avg"),
        F.min(col(score)).alias("prob_min"),
        F.max(col(score)).alias("prob_max"),
    )


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram; the last bin is closed, empty bins are listed.

    A constant column gets a range of one around its value.
    """
    value = known_number(col(name))
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = (
        df.filter(value.isNotNull())
        .select(place.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (low + F.col("bin") * ((high - low) / bins)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def table_shape(df: DataFrame, key: str) -> DataFrame:
    """Rows, columns and distinct non-null keys."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.countDistinct(col(key)).alias("n_keys"),
    )


def stage_funnel(df: DataFrame, stage: str, outcome: str, target: str) -> DataFrame:
    """Rows at the start, removed as first stages, removed as unknown, and kept."""
    first = col(stage).isin(*fixed.FIRST_STAGES)
    unknown = ~first & (col(outcome) == fixed.OUTCOME_UNKNOWN)
    kept = ~first & ~unknown

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0))

    return df.agg(
        F.count("*").alias("n_start"),
        count(first).alias("n_first_stage"),
        count(unknown).alias("n_unknown"),
        count(kept).alias("n_kept"),
        F.round(F.avg(F.when(kept, col(target))), 3).alias("target_rate"),
    )


def valid_columns(df: DataFrame) -> list[str]:
    """Columns with more than one distinct value."""
    rows = missing_and_cardinality(df).filter("nunique > 1").select("feature").collect()
    found = {r["feature"] for r in rows}
    return [c for c in df.columns if c in found]


def drop_invalid_columns(df: DataFrame) -> DataFrame:
    """Drop constant and all-null columns."""
    return df.select(*cols(valid_columns(df)))


def clean_columns(df: DataFrame, max_missing: float = 0.7) -> DataFrame:
    """Drop columns with too many nulls (rate at 3 digits) and constant ones."""
    bad = column_profile(df).filter((F.col("missing_rate") > max_missing) | (F.col("nunique") == 1))
    drop = {r["coluna"] for r in bad.select("coluna").collect()}
    return df.select(*cols([c for c in df.columns if c not in drop]))


