import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import metrics, prefix, profile, ranking, split


def scores(spark, labels, values):
    rows = [(y, p, i) for i, (y, p) in enumerate(zip(labels, values))]
    return spark.createDataFrame(rows, "y_true int, score double, id long")


@pytest.mark.parametrize("sample", [1.0, 0.01])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_sorted_sum(spark, monkeypatch, descending, sample):
    monkeypatch.setattr(prefix, "SAMPLE", sample)
    rng = random.Random(5)
    rows = [("f", float(rng.randrange(40)), 1) for _ in range(900)]  # heavy ties
    rows += [("g", rng.gauss(0, 1e6), rng.randrange(5)) for _ in range(700)]
    rows += [("g", 7.5, 2)] * 400 + [("f", None, 9), ("h", 1.0, 3)]
    df = spark.createDataFrame(rows, "feature string, value double, w int")
    got = prefix.running_totals(df, "value", {"w": F.col("w")}, feature="feature", descending=descending)
    want = []
    for name in "fgh":
        values = sorted({v for f, v, _ in rows if f == name and v is not None}, reverse=descending)
        total = 0
        for value in values:
            own = sum(w for f, v, w in rows if f == name and v == value)
            total += own
            want.append((name, value, own, total))
    found = [(r.feature, r.value, r.w, r.cum_w) for r in got.collect()]
    assert sorted(found) == sorted(want)


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "value double")
    assert prefix.running_totals(df, "value", {"n": F.lit(1)}).count() == 0


def test_quantiles_interpolate(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SAMPLE", 0.5)
    rng = random.Random(2)
    a = [rng.gauss(0, 1) for _ in range(501)] + [3.0] * 250
    b = [float(rng.randrange(4)) for _ in range(700)] + [None] * 51
    df = spark.createDataFrame(list(zip(a, b)), "`a.x` double, b double")
    shares = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "max": 1.0}
    got = {r.feature: r for r in prefix.quantiles(df, ["a.x", "b"], shares).collect()}
    for name, values in (("a.x", a), ("b", [v for v in b if v is not None])):
        for share, q in shares.items():
            assert got[name][share] == pytest.approx(np.quantile(values, q))


def test_metrics_on_known_vectors(spark):
    toy = scores(spark, [1, 0, 1, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5])
    assert metrics.roc_auc(toy).first()[0] == pytest.approx(0.5)
    assert metrics.average_precision(toy).first()[0] == pytest.approx(0.755556, abs=1e-6)
    both = metrics.ranking_scores(toy).first()
    assert (both.roc_auc, both.pr_auc) == (pytest.approx(0.5), pytest.approx(0.755556, abs=1e-6))
    assert metrics.recall_at(toy, 0.4, tie="id").first().recall == pytest.approx(1 / 3)
    one_class = scores(spark, [1, 1], [0.1, 0.2])
    assert metrics.roc_auc(one_class).first()[0] is None


def test_ranking_metrics_with_heavy_ties(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SAMPLE", 1.0)
    rng = random.Random(9)
    labels = [rng.randrange(2) for _ in range(600)]
    values = [round(rng.random() * 0.3 + 0.3 * y, 1) for y in labels]
    df = scores(spark, labels, values)
    pos = [p for y, p in zip(labels, values) if y]
    neg = [p for y, p in zip(labels, values) if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    average, recall_before = 0.0, 0.0
    for cut in sorted(set(values), reverse=True):
        taken = [y for y, p in zip(labels, values) if p >= cut]
        recall = sum(taken) / len(pos)
        average += (recall - recall_before) * sum(taken) / len(taken)
        recall_before = recall
    assert metrics.average_precision(df).first()[0] == pytest.approx(average)
    order = sorted(range(600), key=lambda i: (-values[i], i))
    for share in (0.0, 0.1, 0.2, 0.5, 1.0):
        hits = sum(labels[i] for i in order[: int(600 * share)])
        got = metrics.recall_at(df, share, tie="id").first()
        assert got.recall == pytest.approx(hits / len(pos)) and got.n_taken == int(600 * share)


def test_threshold_metrics(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 10 + [(0, 1)] * 20 + [(0, 0)] * 40
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    assert metrics.f1_score(df).first()[0] == pytest.approx(60 / 90)
    cells = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(1, 1): 30, (1, 0): 10, (0, 1): 20, (0, 0): 40}
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["1"].precision == pytest.approx(0.6) and report["0"].recall == pytest.approx(2 / 3)
    assert report["accuracy"].f1 == pytest.approx(0.7) and report["weighted avg"].support == 100
    assert report["macro avg"].recall == pytest.approx((2 / 3 + 0.75) / 2)
    nothing = spark.createDataFrame([(0, 0)], "y_true int, y_pred int")
    assert metrics.f1_score(nothing).first()[0] == 0.0
    assert {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(nothing).collect()}[(1, 1)] == 0


def test_top_k_cuts_sorts_and_labels(spark):
    df = spark.createDataFrame(
        [("j", "a", 0.1, 0), ("j", "b", 0.9, 1), ("j", "c", 0.5, 2)], "job string, id string, p double, pos int"
    )
    best = ranking.top_k_per_group(df, "job", "p", "pos", k=2).orderBy("rank").collect()
    assert [(r.id, r.label) for r in best] == [("b", 1), ("c", 0)]
    tied = df.withColumn("p", F.lit(0.5))
    assert [r.id for r in ranking.top_k_per_group(tied, "job", "p", "pos", k=2).orderBy("rank").collect()] == ["a", "b"]
    for k in (0, 1001):
        with pytest.raises(ValueError):
            ranking.top_k_per_group(df, "job", "p", "pos", k=k)


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("p"), "id")
    best = ranking.top_k_per_group(df, "g", "p", "id", k=1000)
    plan = best._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]


def test_two_step_cut_finds_the_best_rows(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1009).alias("p"), "id")
    rows = sorted(((r.g, -r.p, r.id) for r in df.collect()))
    best = {(g, i) for g in (0, 1) for _, _, i in [r for r in rows if r[0] == g][:50]}
    assert {(r.g, r.id) for r in ranking.top_k_per_group(df, "g", "p", "id", k=50).collect()} == best


def test_cut_points_are_counted_exactly(spark):
    cuts = [float(x) for x in range(0, 200, 2)]
    df = spark.range(-3, 210).select((F.col("id") / 2).alias("v"), (F.col("id") + 0.0).alias("w"))
    for n in (0, 1, 2, 7, 100):
        place = prefix._place(F.lit(cuts[:n]) if n else F.array().cast("array<double>"), F.col("w"))
        for r in df.select("w", place.alias("k")).collect():
            assert r.k == sum(c < r.w for c in cuts[:n])


def test_first_rows_and_fields(spark):
    df = spark.createDataFrame(
        [("1", "x", 3, "late"), ("1", "x", 1, None), ("1", "y", 2, "b"), ("2", "x", 5, "c")],
        "codigo_vaga string, codigo_applicant string, pos int, t string",
    )
    unique = {(r.codigo_vaga, r.codigo_applicant, r.pos) for r in ranking.dedupe_candidates(df, "pos").collect()}
    assert unique == {("1", "x", 1), ("1", "y", 2), ("2", "x", 5)}
    fields = {(r.codigo_vaga, r.t) for r in ranking.group_fields(df, "codigo_vaga", "pos", ["t"]).collect()}
    assert fields == {("1", None), ("2", "c")}
    by_hint = ranking.dedupe_candidates(df, "pos", hint="t")
    assert by_hint.count() == 4


def test_unknown_job_names_existing_ids(spark):
    df = spark.createDataFrame([(float(i),) for i in range(40)], "codigo_vaga double")
    assert ranking.require_job(df, "codigo_vaga", "7").count() == 1
    with pytest.raises(ValueError, match="existing ids.*'0', '1', '10'"):
        ranking.require_job(df, "codigo_vaga", "99")
    assert ranking.sample_keys(df, "codigo_vaga").count() == 15


@pytest.mark.parametrize("groups, share", [(1, 0.2), (10, 0.2), (35, 0.2), (101, 0.5)])
def test_group_split_keeps_groups_whole(spark, groups, share):
    df = spark.range(groups * 7).select((F.col("id") % groups).cast("string").alias("g"), "id")
    marked = split.with_group_split(df, "g", share)
    rows = marked.groupBy("g").agg(F.min("is_test").alias("a"), F.max("is_test").alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert sum(r.a for r in rows) == math.ceil(share * groups)
    train, test = split.train_test(df, "g", share)
    assert train.count() + test.count() == groups * 7
    again = split.with_group_split(df, "g", share).filter("is_test = 1").select("g").distinct().collect()
    assert {r.g for r in again} == {r.g for r in rows if r.a}


def test_split_treats_rows_without_group_as_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    marked = split.with_group_split(df, "g", 0.5).filter("g is null").select("is_test").distinct()
    assert marked.count() == 1


def test_histogram(spark):
    values = [0.0, 1.0, 29.9, 30.0, 30.0, 15.2]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r.n for r in profile.histogram(df, "x").orderBy("bin").collect()]
    want, _ = np.histogram(values, bins=30)
    assert got == list(want)
    flat = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").orderBy("bin").collect()
    want, edges = np.histogram([2.0, 2.0], bins=30)
    assert [r.n for r in flat] == list(want) and flat[0].bin_start == edges[0]


def test_profiles(spark):
    rows = [("a" * 70, None, 1, "k"), ("b" * 70, None, 2, "k"), (None, None, 2, "k")]
    df = spark.createDataFrame(rows, "t string, nulo string, `n.x` int, c string")
    found = {r.coluna: (r.tipo, r.missing_rate, r.nunique) for r in profile.column_profile(df).collect()}
    assert found == {
        "t": ("categorical", 0.333, 2),  # mean length (70 + 70 + 3) / 3 is below 50
        "nulo": ("numeric", 1.0, 0),
        "n.x": ("numeric", 0.0, 2),
        "c": ("categorical", 0.0, 1),
    }
    assert profile.drop_invalid_columns(df).columns == ["t", "n.x"]
    assert profile.clean_columns(df).columns == ["t", "n.x"]
    audit = {r.coluna: r for r in profile.column_audit(df).collect()}
    assert audit["n.x"].exemplos == "1, 2" and audit["nulo"].exemplos == "" and audit["nulo"].missing_ratio == 1.0
    shape = profile.table_shape(df, "c").first()
    assert (shape.n_rows, shape.n_columns, shape.n_keys) == (3, 4, 1)


def test_audit_examples_of_texts_with_one_long_head(spark):
    texts = ["h" * 100 + c for c in "gfedcba"] * 3 + ["z", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    audit = {r.coluna: r for r in profile.column_audit(df).collect()}
    assert audit["t"].exemplos.split(", ") == ["h" * 100 + c for c in "abcde"]
    assert audit["t"].n_unique == 8 and audit["n"].exemplos == "0, 1, 10, 11, 12"


def test_class_balance_guards_against_no_positive(spark):
    row = profile.class_balance(spark.createDataFrame([(0,), (0,)], "y int"), "y").first()
    assert (row.neg, row.pos, row.scale_pos_weight, row.target_rate) == (2, 0, 2.0, 0.0)


def test_describe(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "x double, z double")
    rows = {r.feature: r for r in profile.describe(df, ["x", "z"]).collect()}
    x = rows["x"]
    assert (x["count"], x["min"], x.p25, x.p50, x.p75, x["max"]) == (11, 0.0, 2.5, 5.0, 7.5, 10.0)
    assert x["std"] == pytest.approx(np.std(range(11), ddof=1))
    assert rows["z"]["count"] == 0 and rows["z"].p50 is None


def counted_rows(spark, df):
    """The table, and how often one of its rows was read so far."""
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    kept = F.udf(seen, df.schema["a"].dataType).asNondeterministic()
    return df.withColumn("a", kept("a")), read


def test_describe_reads_its_rows_once(spark):
    rows = [(float(i % 7), i) for i in range(300)] + [(None, None), (math.nan, 5)]
    df, read = counted_rows(spark, spark.createDataFrame(rows, "a double, b int"))
    got = {r.feature: r for r in profile.describe(df.withColumn("c", F.lit(None).cast("int")), ["a", "b", "c"]).collect()}
    a = [v for v, _ in rows if v is not None and v == v]
    assert (got["a"]["count"], got["a"]["min"], got["a"]["max"], got["a"].p50) == (300, 0.0, 6.0, 3.0)
    assert (got["a"]["mean"], got["a"]["std"]) == (pytest.approx(np.mean(a)), pytest.approx(np.std(a, ddof=1)))
    assert got["b"]["count"] == 301 and tuple(got["c"])[1:] == (0, *[None] * 7)
    assert read.value == len(rows)


def test_describe_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(4.0,)], "a double")
    assert tuple(profile.describe(one, ["a"]).first()) == ("a", 1, 4.0, None, 4.0, 4.0, 4.0, 4.0, 4.0)
    assert profile.describe(one.limit(0), ["a"]).count() == 0
