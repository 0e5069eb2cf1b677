"""Feature drift between a reference and a production table.

All numeric columns go through one ``unpivot`` and one set of running totals,
all others through one ``unpivot`` and one value count, however many columns
there are. From there on the tables hold one row per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.pvalues import drift_p_value
from screenspark.functions.scalars import known_number
from screenspark.names import col, cols
from screenspark.operators.joins import aligned_counts
from screenspark.operators.prefix import ordered_totals, summed_values
from screenspark.operators.profile import is_numeric, value_key, value_text, value_texts
from screenspark.session import written

EMPTY = "feature string, statistic double, dof int"


def common_columns(ref: DataFrame, prod: DataFrame) -> list[str]:
    return sorted(set(ref.columns) & set(prod.columns))


def split_by_kind(ref: DataFrame, prod: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns numeric in both tables, and the rest."""
    kinds_r, kinds_p = dict(ref.dtypes), dict(prod.dtypes)

    def number(name: str) -> bool:
        return all(is_numeric(k[name]) or k[name] == "boolean" for k in (kinds_r, kinds_p))

    return [n for n in names if number(n)], [n for n in names if not number(n)]


def chi_square(ref: DataFrame, prod: DataFrame, names: Sequence[str]) -> DataFrame:
    """Statistic of production counts against reference shares, per column.

    A value the reference never has is divided by 1 instead of its expected 0.
    Columns without any value on one side give no row.
    """
    return _chi_square(aligned_counts(value_texts(ref, names), value_texts(prod, names), names, value_key))


def _chi_square(counts: DataFrame) -> DataFrame:
    """From ``feature, value, ref_c, prod_c``, one row per value."""
    totals = counts.groupBy(F.col("feature").alias("total_feature")).agg(
        F.sum("ref_c").alias("ref_n"), F.sum("prod_c").alias("prod_n")
    )
    expected = F.col("ref_c") / F.col("ref_n") * F.col("prod_n")
    # One total per column: the broadcast is as small as the column list.
    known = counts.join(F.broadcast(totals), F.col("feature") == F.col("total_feature")).filter(
        "ref_n > 0 and prod_n > 0"
    )
    divisor = F.when(F.col("ref_c") == 0, F.lit(1.0)).otherwise(F.col("expected"))
    return (
        known.withColumn("expected", expected)
        .groupBy("feature")
        .agg(
            F.sum((F.col("prod_c") - F.col("expected")) ** 2 / divisor).alias("statistic"),
            F.greatest(F.count("*") - 1, F.lit(1)).cast("int").alias("dof"),
        )
    )


def kolmogorov_smirnov(ref: DataFrame, prod: DataFrame, names: Sequence[str]) -> DataFrame:
    """Largest gap of the two empirical distributions, per column."""

    def long(df: DataFrame, is_ref: int) -> DataFrame:
        numbers = df.select(*[known_number(col(n)).alias(n) for n in names])
        return numbers.unpivot([], cols(names), "feature", "value").withColumn("is_ref", F.lit(is_ref))

    both = long(ref, 1).unionByName(long(prod, 0)).filter("value is not null")
    counts = {"ref_c": F.col("is_ref"), "prod_c": 1 - F.col("is_ref")}
    return _largest_gap(written(summed_values(both, "value", counts, "feature")))


def _largest_gap(counts: DataFrame) -> DataFrame:
    """From ``feature, v`` and how often each side has the value; several passes read it."""
    sums = ordered_totals(counts, ["ref_c", "prod_c"])
    totals = counts.groupBy(F.col("feature").alias("total_feature")).agg(
        F.sum("ref_c").alias("ref_n"), F.sum("prod_c").alias("prod_n")
    )
    gap = F.abs(F.col("cum_ref_c") / F.col("ref_n") - F.col("cum_prod_c") / F.col("prod_n"))
    return (
        sums.join(F.broadcast(totals), F.col("feature") == F.col("total_feature"))
        .filter("ref_n > 0 and prod_n > 0")
        .groupBy("feature")
        .agg(F.max(gap).alias("statistic"))
    )


def _value_numbers(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    counts = value_texts(df, names).agg(*[F.count(col(n)).alias(n) for n in names])
    return counts.unpivot([], cols(names), "feature", out)


def drift_report(
    ref: DataFrame,
    prod: DataFrame,
    alpha: float = fixed.DRIFT_ALPHA,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per column: test, statistic, p-value, drift flag and row numbers.

    A column without values on one side has no statistic and does not drift. An
    all-null column counts as numeric when both sides agree on it being so.
    """
    names = common_columns(ref, prod) if columns is None else list(columns)
    numbers, others = split_by_kind(ref, prod, names)
    spark = ref.sparkSession
    ks = kolmogorov_smirnov(ref, prod, numbers) if numbers else spark.createDataFrame([], EMPTY)
    chi = chi_square(ref, prod, others) if others else spark.createDataFrame([], EMPTY)
    stats = chi.unionByName(ks, allowMissingColumns=True).withColumnRenamed("feature", "stat_feature")
    sizes = _value_numbers(ref, names, "ref_n").join(
        _value_numbers(prod, names, "prod_n"), "feature"
    )
    return _report(stats, sizes, numbers, alpha)


def _report(stats: DataFrame, sizes: DataFrame, numbers: Sequence[str], alpha: float) -> DataFrame:
    """Statistics and numbers of values, one row per column each, as a report."""
    is_number = F.col("feature").isin(*numbers) if numbers else F.lit(False)
    no_values = (F.col("ref_n") == 0) & (F.col("prod_n") == 0)
    test = F.when(is_number | no_values, "ks").otherwise("chi2")
    rows = sizes.join(F.broadcast(stats), F.col("feature") == F.col("stat_feature"), "left").select(
        "feature", test.alias("test"), "statistic", "dof", "ref_n", "prod_n"
    )
    p_value = drift_p_value("test", "statistic", F.coalesce("dof", F.lit(1)), "ref_n", "prod_n")
    return sorted_report(
        rows.withColumn("p_value", p_value).select(
            "feature",
            "test",
            "statistic",
            "p_value",
            F.lit(float(alpha)).alias("alpha"),
            F.coalesce(F.col("p_value") <= alpha, F.lit(False)).alias("drift"),
            "ref_n",
            "prod_n",
        )
    )


# ---- stored profiles ------------------------------------------------------------------------


def drift_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What a drift report needs of a table: ``feature, is_number, key, value, n``.

    One row per column and distinct value with its count, and one without key per
    column, so that columns without values are known. Long texts are digests. Written
    as a table it stands for ``df`` in later reports, and profiles of parts add up.
    """
    names = list(df.columns if columns is None else columns)
    numbers = {n for n in names if is_numeric(dict(df.dtypes)[n]) or dict(df.dtypes)[n] == "boolean"}

    def entry(name: str, key: Column, value: Column) -> Column:
        fields = {"feature": F.lit(name), "is_number": F.lit(name in numbers), "key": key, "value": value.cast("double")}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    nothing = F.lit(None).cast("string")
    each = [entry(n, value_key(value_text(df, n)), known_number(col(n)) if n in numbers else F.lit(None)) for n in names]
    rows = df.select(F.inline(F.array(*each))).filter("key is not null").groupBy("feature", "is_number", "key", "value")
    known = df.sparkSession.range(1).select(F.inline(F.array(*[entry(n, nothing, F.lit(None)) for n in names])))
    return rows.agg(F.count("*").alias("n")).unionByName(known.withColumn("n", F.lit(0).cast("long")))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows behind some profiles, in whatever order they are merged.

    A column is numeric if it is in every part.
    """
    every = reduce(DataFrame.unionByName, profiles)
    kinds = every.groupBy(F.col("feature").alias("kind_of")).agg(F.min("is_number").alias("all_numbers"))
    # One row per column: the broadcast is as small as the column list.
    named = every.join(F.broadcast(kinds), F.col("feature") == F.col("kind_of"))
    return named.groupBy("feature", F.col("all_numbers").alias("is_number"), "key", "value").agg(F.sum("n").alias("n"))


def profile_report(
    ref: DataFrame,
    prod: DataFrame,
    alpha: float = fixed.DRIFT_ALPHA,
    keep: Callable[[DataFrame], DataFrame] = lambda counts: counts,
) -> DataFrame:
    """The drift report of the tables behind two profiles; neither table is read.

    Several steps read the counts of both sides by value: ``keep`` may store them, as ``written`` does.
    """
    both = ref.withColumn("is_ref", F.lit(1)).unionByName(prod.withColumn("is_ref", F.lit(0)))
    both = both.withColumns({"ref_c": F.col("n") * F.col("is_ref"), "prod_c": F.col("n") * (1 - F.col("is_ref"))})
    sides = both.groupBy("feature").agg(F.min("is_number").alias("is_number"), F.countDistinct("is_ref").alias("sides"))
    numbers, others = [], []
    for row in sides.filter("sides = 2").collect():  # one row per column
        (numbers if row["is_number"] else others).append(row["feature"])
    # A row per value of a column: numbers by value, all others by key.
    as_number = F.col("feature").isin(numbers)
    sums = [F.sum(n).alias(n) for n in ("ref_c", "prod_c")]
    entries = both.filter(F.col("feature").isin(numbers + others)).select(
        "feature", F.when(~as_number, F.col("key")).alias("key"), F.when(as_number, F.col("value")).alias("v"), "ref_c", "prod_c"
    )
    counts = keep(entries.groupBy("feature", "key", "v").agg(*sums))
    stats = _chi_square(counts.filter("key is not null")) if others else ref.sparkSession.createDataFrame([], EMPTY)
    if numbers:
        ks = _largest_gap(counts.filter("v is not null").drop("key"))
        stats = stats.unionByName(ks, allowMissingColumns=True)
    sizes = counts.groupBy("feature").agg(F.sum("ref_c").alias("ref_n"), F.sum("prod_c").alias("prod_n"))
    return _report(stats.withColumnRenamed("feature", "stat_feature"), sizes, numbers, alpha)


def sorted_report(report: DataFrame) -> DataFrame:
    """Drifted columns first, then by p-value with missing ones last."""
    return report.orderBy(F.desc("drift"), F.asc_nulls_last("p_value"), "feature")


def drift_summary(report: DataFrame, gate: float = fixed.DRIFT_GATE) -> DataFrame:
    """One row: columns tested, drifted, their rate, and whether the gate fails."""

    def known(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    rate = F.coalesce(F.avg(F.col("drift").cast("int")), F.lit(0.0))
    return report.agg(
        F.count("*").alias("n_features"),
        known(F.sum(F.col("drift").cast("int"))).alias("n_drifted"),
        rate.alias("drift_rate"),
    ).withColumn("failed", F.col("drift_rate") >= gate)
