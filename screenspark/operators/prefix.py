"""Running totals over a globally ordered column without a one-task window.

One pass over the rows sums them up by distinct value; the sums are written once and
all that follows reads them, not the rows. The values are cut into ranges at quantiles
of a sample of them. The cut points come back to the driver (one per shuffle partition
and feature) and become constants, so every later reader of the table, also after a
lost executor, sees the same ranges. Each range is summed on its own and shifted by
the totals of the ranges before it. The cut points only balance the work; every row is
summed, and the totals are exact for any cuts. A column too short to be sampled is one
range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.scalars import known_number
from screenspark.names import col, cols
from screenspark.session import parallelism, written

# Share of the distinct values that is looked at to place the cut points.
SAMPLE = 0.01
# Steps of the search among the cut points: enough for 65,535 of them.
STEPS = [1 << i for i in range(15, -1, -1)]


def _cut_points(df: DataFrame) -> dict[str, list[float]]:
    ranges = max(2, parallelism(df.sparkSession))
    steps = F.lit([i / ranges for i in range(1, ranges)])
    found = (
        df.sample(SAMPLE, seed=1)
        .groupBy("feature")
        .agg(F.percentile_approx("v", steps, 10 * ranges).alias("cuts"))
        .collect()
    )
    return {r["feature"]: sorted(set(r["cuts"] or [])) for r in found}


def _with_cuts(df: DataFrame, cuts: dict[str, list[float]], single: bool) -> DataFrame:
    """Attach every feature's cut points: a constant, or a join with one row per feature."""
    none = F.array().cast("array<double>")
    if single:
        points = next(iter(cuts.values()), [])
        return df.withColumn("cuts", F.lit(points) if points else none)
    table = df.sparkSession.createDataFrame(list(cuts.items()), "cut_feature string, found array<double>")
    joined = df.join(F.broadcast(table), F.col("feature") == F.col("cut_feature"), "left")
    return joined.withColumn("cuts", F.coalesce("found", none))


def _place(cuts: Column, value: Column) -> Column:
    """How many cut points lie below a value, by halving steps; a step past the last one is none."""
    steps = F.lit(STEPS)
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when(F.get(cuts, k + s - 1) < value, k + s).otherwise(k))


def summed_values(df: DataFrame, value: str, weights: Mapping[str, Column], feature: str | None = None) -> DataFrame:
    """``feature, v`` and the weight sums, one row per distinct ``value``, null among them.

    ``v`` is the value as a double, ``feature`` empty where none is given.
    """
    named = F.lit("") if feature is None else col(feature)
    base = df.select(
        named.alias("feature"), col(value).cast("double").alias("v"), *[w.alias(n) for n, w in weights.items()]
    )
    return base.groupBy("feature", "v").agg(*[F.sum(n).alias(n) for n in weights])


def running_totals(
    df: DataFrame,
    value: str,
    weights: Mapping[str, Column],
    feature: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Per distinct ``value`` (within ``feature``) the weight sums and their running sums.

    Result: ``feature`` (if given), ``value``, each weight's own sum under its
    name and the sum up to and including this value as ``cum_<name>``. ``value``
    must be numeric; rows with a null value are left out.
    """
    sums = written(summed_values(df, value, weights, feature))
    out = ordered_totals(sums, list(weights), descending, feature is None).withColumnRenamed("v", value)
    return out.drop("feature") if feature is None else out.withColumnRenamed("feature", feature)


def ordered_totals(
    sums: DataFrame, weights: Sequence[str], descending: bool = False, single: bool = False
) -> DataFrame:
    """Running sums over ``summed_values``, which several passes read; null values are left out."""
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    sums = sums.filter("v is not null").withColumn("v", F.col("v") * sign)
    cuts = _cut_points(sums)
    ranged = _with_cuts(sums, cuts, single).select(
        "feature",
        "v",
        *weights,
        _place(F.col("cuts"), F.col("v")).alias("part"),
    )
    totals = ranged.groupBy("feature", "part").agg(*[F.sum(n).alias(n) for n in weights])
    # One row per feature and range: small by construction.
    earlier = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("feature"),
        F.col("part"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in weights],
    )
    inside = (
        Window.partitionBy("feature", "part")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = ranged.select(
        "feature", "part", "v", *weights, *[F.sum(n).over(inside).alias(f"in_{n}") for n in weights]
    )
    return summed.join(F.broadcast(offsets), ["feature", "part"]).select(
        F.col("feature"),
        # Adding zero turns the -0.0 a sign change leaves into 0.0.
        (F.col("v") * sign + F.lit(0.0)).alias("v"),
        *cols(weights),
        *[(F.col(f"before_{n}") + F.col(f"in_{n}")).alias(f"cum_{n}") for n in weights],
    )


def quantiles(df: DataFrame, names: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per column, one column per share.

    Non-null values only (NaN counts as null); a column without any gives no row.
    """
    return quantiles_of(number_counts(df, names), shares)


def number_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature, v, n``: how often each column has each number, null (and NaN) among them; a written table."""
    numbers = df.select(*[known_number(col(n)).alias(n) for n in names])
    long = numbers.unpivot([], cols(names), "feature", "value")
    return written(summed_values(long, "value", {"n": F.lit(1)}, "feature"))


def quantiles_of(counts: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Quantiles of the columns behind ``number_counts``."""
    totals = counts.filter("v is not null").groupBy("feature").agg(F.sum("n").alias("total"))
    placed = ordered_totals(counts, ["n"]).join(F.broadcast(totals), "feature")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col("v")))

    picks = []
    for name, share in shares.items():
        exact = F.lit(float(share)) * (F.col("total") - 1)
        picks += [
            at(F.floor(exact)).alias(f"low_{name}"),
            at(F.ceil(exact)).alias(f"high_{name}"),
            F.max(exact - F.floor(exact)).alias(f"part_{name}"),
        ]
    ends = placed.groupBy("feature").agg(*picks)
    return ends.select(
        "feature",
        *[
            (col(f"low_{n}") + (col(f"high_{n}") - col(f"low_{n}")) * col(f"part_{n}")).alias(n)
            for n in shares
        ],
    )
