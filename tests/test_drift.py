import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.functions import pvalues
from screenspark.operators import drift
from screenspark.session import FREE_SHUFFLES, written


def test_published_ks_p_values():
    large = pvalues.ks_tail(0.015818666805253956, 29752, 5950)
    assert large == pytest.approx(0.1654187936326309, rel=1e-9)
    exact = pvalues.ks_tail(0.04809993033189174, 5687, 1027)
    assert exact == pytest.approx(0.034410896430004105, rel=1e-9)


def test_exact_ks_tail_equals_enumeration():
    n, m = 4, 5
    for bound in (0.3, 0.55, 0.8, 1.0):
        hits = total = 0
        for first in itertools.combinations(range(n + m), n):
            marks = [i in first for i in range(n + m)]
            a = np.cumsum(marks) / n
            b = np.cumsum([not x for x in marks]) / m
            gaps = np.abs(a - b)
            total += 1
            hits += gaps.max() >= round(bound * n * m) / (n * m) - 1e-12
        assert pvalues.ks_tail_exact(bound, n, m) == pytest.approx(hits / total)


def test_published_chi2_p_values():
    # Two-category and five-category rows of a published report.
    assert pvalues.chi2_tail(1.2415289070930822, 1) == pytest.approx(0.26517659948324446, rel=1e-9)
    assert pvalues.chi2_tail(15.921780564531817, 4) == pytest.approx(0.0031259385704139886, rel=1e-6)
    assert pvalues.chi2_tail(33.333333, 2) == pytest.approx(np.exp(-33.333333 / 2))
    assert pvalues.chi2_tail(0.0, 3) == 1.0
    assert pvalues.chi2_tail(3994.24, 3700) == pytest.approx(0.0004, abs=0.0003)


def counted(spark, counts):
    rows = [(k,) for k, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string")


def test_chi2_statistic_with_a_value_the_reference_lacks(spark):
    ref, prod = counted(spark, {"a": 50, "b": 50}), counted(spark, {"a": 10, "c": 5})
    row = drift.chi_square(ref, prod, ["c"]).first()
    assert row.statistic == pytest.approx(33.333333, abs=1e-5) and row.dof == 2


def test_ks_statistic_equals_brute_force(spark):
    rng = random.Random(4)
    a = [rng.gauss(0, 1) for _ in range(400)] + [0.0] * 200
    b = [rng.gauss(0.3, 1) for _ in range(300)] + [0.0] * 50
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    got = drift.kolmogorov_smirnov(frame(a), frame(b), ["x"]).first().statistic
    points = np.array(sorted(set(a + b)))
    gap = np.abs(
        np.searchsorted(np.sort(a), points, "right") / len(a) - np.searchsorted(np.sort(b), points, "right") / len(b)
    ).max()
    assert got == pytest.approx(gap)


def test_report_summary_and_gate(spark):
    schema = "n int, k string, nulo string, soref string"
    ref = spark.createDataFrame([(i, "ab"[i % 2], None, "x") for i in range(300)], schema)
    prod = spark.createDataFrame([(i + 150, "ab"[i % 2], None, None) for i in range(200)], schema)
    report = drift.drift_report(ref, prod).collect()
    by_name = {r.feature: r for r in report}
    assert report[0].feature == "n" and by_name["n"].drift and by_name["n"].test == "ks"
    assert by_name["k"].test == "chi2" and not by_name["k"].drift
    assert by_name["nulo"].test == "ks" and by_name["nulo"].p_value is None and by_name["nulo"].ref_n == 0
    assert by_name["soref"].statistic is None and by_name["soref"].ref_n == 300 and not by_name["soref"].drift
    summary = drift.drift_summary(drift.drift_report(ref, prod)).first()
    assert (summary.n_features, summary.n_drifted, summary.drift_rate, summary.failed) == (4, 1, 0.25, False)
    only = drift.drift_summary(drift.drift_report(ref, prod, columns=["n"])).first()
    assert only.failed


def test_small_effective_samples_follow_the_exact_law():
    assert pvalues.ks_tail(0.6, 10_001, 3) == pytest.approx(0.144, abs=1e-4)
    assert pvalues.ks_tail(0.4, 10_001, 5) == pytest.approx(0.3088, abs=1e-4)
    near = pvalues.ks_tail_one_sample(0.1, 80)
    pvalues_large = pvalues.EXACT_SIZE
    assert pvalues_large == 80 and near == pytest.approx(0.37559, abs=1e-4)


def test_chi_square_of_very_many_categories_converges():
    assert pvalues.chi2_tail(400_000.0, 400_000) == pytest.approx(0.4997, abs=1e-3)


def test_nan_is_missing_in_drift(spark):
    nan = float("nan")
    ref = spark.createDataFrame([(1.0, "a"), (nan, "b"), (2.0, "a"), (3.0, None)], "x double, t string")
    prod = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (nan, "b")], "x double, t string")
    rows = {r.feature: r for r in drift.drift_report(ref, prod).collect()}
    assert (rows["x"].ref_n, rows["x"].prod_n, rows["x"].statistic) == (3, 3, 0.0)
    assert (rows["t"].ref_n, rows["t"].prod_n) == (3, 4)


def profiled(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else "abcde"[i % 4] * (1 + 200 * (i % 3)), i % 2 == 0, None, float("nan") if i % 9 == 0 else i / 3) for i in range(120)]
    schema = "id long, num double, txt string, flag boolean, empty string, frac double"
    return spark.createDataFrame(rows, schema)


def same_report(a, b):
    rows = [[tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()] for d in (a, b)]
    assert sorted(rows[0], key=repr) == sorted(rows[1], key=repr) and rows[0]


def test_report_from_profiles_equals_the_one_from_rows_in_any_merge_order(spark):
    ref = profiled(spark)
    prod = ref.filter("id < 60").withColumn("num", F.col("num") + 1).withColumn("other", F.lit(1))
    want = drift.drift_report(ref, prod)
    parts = [drift.drift_profile(ref.filter(f"id % 3 = {i}")) for i in range(3)]
    same_report(drift.profile_report(drift.drift_profile(ref), drift.drift_profile(prod)), want)
    for order in ((0, 1, 2), (2, 0, 1)):
        a, b, c = (parts[i] for i in order)
        same_report(drift.profile_report(drift.merge_profiles(a, drift.merge_profiles(b, c)), drift.drift_profile(prod)), want)
    empty = ref.limit(0)
    same_report(drift.profile_report(drift.drift_profile(ref), drift.drift_profile(empty)), drift.drift_report(ref, empty))


def test_numbers_on_one_side_only_are_compared_as_texts(spark):
    ref = spark.range(20).select((F.col("id") % 3).alias("x"))
    prod = spark.range(9).select((F.col("id") % 4).cast("string").alias("x"))
    same_report(drift.profile_report(drift.drift_profile(ref), drift.drift_profile(prod)), drift.drift_report(ref, prod))


def test_stored_profile_is_all_that_is_read(spark, tmp_path):
    ref = profiled(spark)
    ref.write.parquet(str(tmp_path / "rows"))
    drift.drift_profile(spark.read.parquet(str(tmp_path / "rows"))).write.parquet(str(tmp_path / "profile"))
    report = drift.profile_report(spark.read.parquet(str(tmp_path / "profile")), drift.drift_profile(ref))
    assert all("/profile/" in f for f in report.inputFiles()) and report.filter("drift").count() == 0


def test_kolmogorov_smirnov_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    kept = F.udf(seen, "double").asNondeterministic()
    ref, prod = (spark.createDataFrame([(float(i),) for i in r], "a double").select(kept("a").alias("a"))
                 for r in (range(0, 200), range(50, 350)))
    got = drift.kolmogorov_smirnov(ref, prod, ["a"]).collect()
    assert [r.statistic for r in got] == [pytest.approx(0.5)]
    assert read.value == 500


def test_report_from_profiles_reads_each_of_them_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    kept = F.udf(seen, "long").asNondeterministic()
    sides = [spark.createDataFrame([(i, "ab"[i % 2]) for i in r], "a long, b string") for r in (range(200), range(50, 350))]
    profiles = [drift.drift_profile(d).withColumn("n", kept("n")) for d in sides]
    rows = sum(p.count() for p in profiles)
    read.value = 0
    got = {r.feature: r.statistic for r in drift.profile_report(*profiles, keep=written).collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.0)}
    assert read.value <= 2 * rows


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = disk.getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    before = shuffles()
    table = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    # Files are deleted in the background.
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == 10 and spark.conf.get(FREE_SHUFFLES) == "false"
