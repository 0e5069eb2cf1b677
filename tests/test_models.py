import json
import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.names import with_ml_names
from screenspark.operators import encode, models, scoring
from screenspark.plans import model_queries
from screenspark.streaming.scoring import read_items, score_stream, stop_after_batches

SPEC = models.FeatureColumns(
    categories=("perfil_vaga.nivel_academico", "formacao.nivel", "modalidade"),
    texts=("cv_pt", "perfil_vaga.principais_atividades"),
    candidate_level="formacao.nivel",
    job_skills="perfil_vaga.principais_atividades",
    candidate_skills="cv_pt",
    bag_size=20,
)


def people(spark, n=120):
    words = ["java", "python", "sap", "dados", "nuvem", "redes"]
    rows = []
    for i in range(n):
        good = i % 3 != 0
        cv = " ".join([words[i % 6], words[(i * 5) % 6], "experiente" if good else "novato"])
        job = f"procura {words[i % 6]} {words[(i + 1) % 6]}"
        level = ["Superior", "Técnico", ""][i % 3]
        rows.append((i, str(i % 20), level, "superior", "remoto" if i % 2 else None, cv, job, int(good)))
    return spark.createDataFrame(
        rows,
        "rid long, codigo_vaga string, `perfil_vaga.nivel_academico` string, `formacao.nivel` string, "
        "modalidade string, cv_pt string, `perfil_vaga.principais_atividades` string, target_triagem int",
    )


@pytest.fixture(scope="module")
def trained(spark):
    estimator = models.logistic_regression(120)
    return models.train(people(spark), "target_triagem", "codigo_vaga", SPEC, estimator, "balanced")


def test_hold_out_has_whole_groups_and_good_scores(trained):
    model, holdout = trained
    rows = holdout.collect()
    assert holdout.columns == ["y_true", "y_pred", "score", "group"]
    assert len({r.group for r in rows}) == 4 and len(rows) == 24
    found = models.holdout_metrics(holdout).first()
    assert found.roc_auc == 1.0 and found.pr_auc == pytest.approx(1.0) and found.f1 == pytest.approx(1.0)
    assert all(r.y_pred == int(r.score >= fixed.THRESHOLD) for r in rows)
    assert model.meta["n_train"] == 96 and model.meta["class_balance"]["pos"] > 0


def test_saved_model_scores_the_same(spark, trained, tmp_path):
    model, holdout = trained
    meta = models.save_model(model, str(tmp_path / "m"), holdout)
    assert meta["n_test"] == 24 and meta["metrics_holdout"]["roc_auc"] == 1.0
    back = models.load_model(spark, str(tmp_path / "m"))
    assert (back.columns, back.threshold) == (SPEC, fixed.THRESHOLD)
    assert back.meta["schema_in"] == json.loads(json.dumps(meta["schema_in"]))
    rows = with_ml_names(people(spark))
    score = lambda m: [r.score for r in models.with_probability(m.pipeline, rows, 0.6).orderBy("rid").collect()]
    assert score(back) == pytest.approx(score(model))


def items(spark):
    return people(spark).select(
        "rid",
        F.create_map(
            F.lit("cv_pt"), F.col("cv_pt"), F.lit("modalidade"), F.col("modalidade"), F.lit("extra"), F.lit("x")
        ).alias("features"),
    )


def test_predict_passes_other_columns_and_warns(spark, trained):
    out = scoring.predict(items(spark), trained[0], warnings="summary", threshold=0.5)
    assert out.columns == [
        "rid", "missing_count", "unknown_count", "prob_next_phase", "label", "threshold",
    ]
    row = out.first()
    assert (row.missing_count, row.unknown_count, row.threshold) == (3, 1, 0.5)


def test_stream_scores_like_the_batch(spark, trained, tmp_path):
    items(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_items(spark, str(tmp_path / "in"), items(spark).schema, files_per_batch=1)
    score_stream(stream, trained[0], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.rid: r.prob_next_phase for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.rid: r.prob_next_phase for r in scoring.predict(items(spark), trained[0]).collect()}
    assert got == pytest.approx(want)


def test_stopped_stream_goes_on_where_it_ended(spark, trained, tmp_path):
    items(spark).repartition(6).write.parquet(str(tmp_path / "in"))

    def run():
        stream = read_items(spark, str(tmp_path / "in"), items(spark).schema, files_per_batch=2)
        return score_stream(stream, trained[0], str(tmp_path / "out"), str(tmp_path / "cp"))

    stop_after_batches(run(), 1)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert first > 0
    run().awaitTermination(120)
    got = [r.rid for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(r.rid for r in items(spark).collect())


def test_ranking_requests(spark, trained):
    jobs = spark.createDataFrame(
        [("v", {"perfil_vaga.principais_atividades": "procura sap", "modalidade": "remoto"})],
        "codigo_vaga string, job_features map<string,string>",
    )
    requests = spark.createDataFrame(
        [("v", [({"external_id": "a"}, {"cv_pt": "novato"}), ({"external_id": "b"}, {"cv_pt": "experiente sap"}),
                ({}, {"cv_pt": "experiente sap"})])],
        "codigo_vaga string, candidatos array<struct<meta:map<string,string>,candidato:map<string,string>>>",
    )
    pairs = scoring.request_pairs(requests, "codigo_vaga")
    best, summary = scoring.rank_candidates(pairs, jobs, trained[0], "codigo_vaga", "pos", top_k=2)
    rows = best.orderBy("rank").collect()
    assert [r.external_id for r in rows] == ["b", None]
    assert summary.first().n_candidates == 3
    empty = spark.createDataFrame([("v", [])], requests.schema)
    with pytest.raises(ValueError, match="Nenhum candidato enviado."):
        scoring.request_pairs(empty, "codigo_vaga")


def test_unknown_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "c string")
    other = spark.createDataFrame([("a",), ("z",), ("",)], "c string")
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = [
        encode.TypeCoercion(inputCols=["c"], emptyAs=encode.EMPTY_CATEGORY),
        StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="i", outputCol="v", dropLast=True),
    ]
    out = Pipeline(stages=stages).fit(train).transform(other).select(vector_to_array("v")).collect()
    assert [list(r[0]) for r in out] == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]


def test_missing_columns_count_as_empty(spark):
    df = spark.createDataFrame([(1,)], "x int")
    row = encode.LevelMatch(jobCol="a", candidateCol="b").transform(df).first()
    assert row.match_nivel_academico == 1.0
    assert encode.SkillOverlap(jobCol="a", candidateCol="b").transform(df).first().overlap_skills == 0.0


def test_text_concat_remembers_the_fitted_columns(spark):
    df = spark.createDataFrame([("x", None, 1)], "a string, b string, n int")
    model = encode.TextConcat(inputCols=["a", "b", "z"], sep="|", dropOriginal=True).fit(df)
    out = model.transform(df.withColumn("z", F.lit("late")))
    assert out.columns == ["n", "z", "text_concat"] and out.first().text_concat == "x|"
    alone = encode.TextConcat(inputCols=["a"]).fit(df).transform(df).first()
    assert alone.text_concat == "x"
    none = encode.TextConcat(inputCols=["z"]).fit(df).transform(df).first()
    assert none.text_concat == ""


def test_similarity_stage_equals_the_table_operator(spark):
    from screenspark.operators import tfidf

    df = people(spark).select("rid", "codigo_vaga", "cv_pt", F.col("`perfil_vaga.principais_atividades`").alias("job"))
    stage = encode.SimilarityTfidf(jobCol="job", candidateCol="cv_pt").fit(df)
    got = {r.rid: r.sim_cv_vaga for r in stage.transform(df).collect()}
    pairs = df.select("rid", F.col("rid").alias("jid"))
    cands = df.select("rid", F.col("cv_pt").alias("text"))
    jobs = df.select(F.col("rid").alias("jid"), F.col("job").alias("text"))
    want = {r.rid: r.sim_cv_vaga for r in tfidf.similarity(pairs, cands, jobs, "jid", "rid").collect()}
    assert got == pytest.approx(want) and max(got.values()) > 0


def test_an_empty_vocabulary_gives_zero_similarity(spark):
    df = spark.createDataFrame([("a", "b")], "cv string, job string")
    model = encode.SimilarityTfidf(jobCol="job", candidateCol="cv").fit(df)
    assert model.transform(df).first().sim_cv_vaga == 0.0


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None), (8.0, "b"), (8.0, "a")], "n double, c string")
    assert encode.medians(df, ["n"]) == {"n": 5.5}
    assert [r.n for r in encode.impute_medians(df, ["n"]).collect()][2] == 5.5
    assert encode.modes(df, ["c"]) == {"c": "a"}
    assert [r.c for r in encode.impute_modes(df, ["c"]).collect()][2] == "a"
    whole = encode.impute_medians(df, ["n"]).withColumn("k", F.lit(4.0))
    scaled = [tuple(r) for r in encode.standard_scale(whole, ["n", "k"]).select("n", "k").collect()]
    values = np.array([1, 3, 5.5, 8, 8])
    assert [s[0] for s in scaled] == pytest.approx(list((values - values.mean()) / values.std()))
    assert {s[1] for s in scaled} == {0.0}


def test_numbers_are_imputed_scaled_and_predicted(spark):
    spec = models.FeatureColumns(
        categories=(), texts=("cv_pt",), numbers=("n.ota", "vazia"), scale_numbers=True,
        job_text="cv_pt", candidate_text="cv_pt",
    )
    nota = F.when(F.col("rid") % 4 != 0, F.col("rid").cast("double"))
    df = people(spark).withColumns({"n.ota": nota, "vazia": F.lit(None).cast("double")})
    features = models.fit_features(with_ml_names(df), spec)
    prepared = next(s for s in features.stages if isinstance(s, encode.NumberPreparationModel))
    values = np.array([i for i in range(120) if i % 4])
    middle = np.median(values)
    whole = np.array([i if i % 4 else middle for i in range(120)])
    assert prepared.getOrDefault("medians") == [middle, 0.0]
    assert prepared.getOrDefault("divisors") == pytest.approx([whole.std(), 1.0])
    estimator = models.logistic_regression(96)
    model, holdout = models.train(df, "target_triagem", "codigo_vaga", spec, estimator, "balanced")
    assert holdout.count() == 24
    maps = df.select("rid", F.create_map(F.lit("n.ota"), F.lit("x"), F.lit("cv_pt"), F.col("cv_pt")).alias("features"))
    assert scoring.predict(maps, model).count() == 120


def test_too_many_categories_are_refused(spark):
    models.check_categories(people(spark), ["rid", "modalidade"], 121)
    with pytest.raises(ValueError, match="rid"):
        models.check_categories(people(spark), ["rid", "modalidade"], 120)


def test_model_comparison(spark):
    estimators = {
        "LogReg": models.logistic_regression(96),
        "RandomForest": models.random_forest(max_depth=4, min_leaf=1, trees=5),
        "Boosted": models.boosted_trees(rounds=3),
    }
    table = models.compare_models(people(spark), "target_triagem", "codigo_vaga", SPEC, "rid", estimators)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == set(estimators)
    assert all(r.roc_auc > 0.9 and 0 < r.recall_at_10 <= r.recall_at_20 <= r.recall_at_50 <= 1 for r in rows.values())


def test_four_rows_train(spark):
    rows = people(spark).filter("rid in (0, 1, 3, 4)").withColumn("target_triagem", (F.col("rid") % 2).cast("int"))
    flat = rows.withColumn("cv_pt", F.lit("a")).withColumn("codigo_vaga", F.col("rid").cast("string"))
    _, holdout = models.train(
        flat, "target_triagem", "codigo_vaga", SPEC, models.boosted_trees(rounds=2), "positive"
    )
    assert holdout.count() == 1


def test_pipeline_model_type(trained):
    assert isinstance(trained[0].pipeline, PipelineModel)


def test_missing_categories_take_the_most_frequent_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    model = encode.CategoryPreparation(inputCols=["c", "absent"]).fit(df.withColumn("absent", F.lit(None).cast("string")))
    rows = model.transform(df).collect()
    assert [r.c for r in rows] == ["a", "a", "b", "a"] and {r.absent for r in rows} == {""}
    spec = replace(SPEC, impute_modes=True, bag_min_df=3.0, bag_size=15)
    _, holdout = models.train(
        people(spark), "target_triagem", "codigo_vaga", spec, models.logistic_regression, "balanced"
    )
    assert holdout.count() == 24


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "n double")
    assert encode.medians(df, ["n"]) == {"n": 2.0}
    assert [r.n for r in encode.impute_medians(df, ["n"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    assert encode.scaling(df, ["n"]) == {"n": (2.0, 1.0)}


def test_the_model_does_not_depend_on_the_input_partitions(spark):
    found = []
    for parts in (1, 7):
        model, _ = models.train(
            people(spark).repartition(parts), "target_triagem", "codigo_vaga", SPEC,
            models.random_forest(max_depth=4, min_leaf=1, trees=7), "balanced", rows_per_partition=30,
        )
        found.append(model.pipeline.stages[-1].toDebugString.split("\n", 1)[1])
    assert found[0] == found[1]


def test_candidates_of_an_unknown_job_are_ranked(spark, trained):
    pairs = spark.createDataFrame(
        [("x", 1, {"cv_pt": "sap"}), ("x", 2, None)], "job string, pos long, candidate_features map<string,string>"
    )
    jobs = spark.createDataFrame([("y", {"a": "b"})], "job string, job_features map<string,string>")
    best, _ = scoring.rank_candidates(pairs, jobs, trained[0], "job", "pos", warnings="summary")
    rows = best.collect()
    assert {r.pos for r in rows} == {1, 2} and {(r.top_k, r.threshold_used) for r in rows} == {(5, 0.6)}
    assert {r.missing_count for r in rows} == {4, 5}


def test_similarity_walks_the_terms_of_the_candidate_only(spark):
    rows = [("sap java nuvem", "java sap"), ("", "java"), ("python", ""), ("sap sap dados", "dados nuvem sap")]
    df = spark.createDataFrame(rows, "cv string, job string")
    terms, idf = ["dados", "java", "nuvem", "sap"], [1.5, 1.25, 2.0, 1.0]
    model = encode.SimilarityTfidfModel(jobCol="job", candidateCol="cv", terms=terms, idf=idf)
    out = model.transform(df)
    weight = dict(zip(terms, idf))

    def unit(text):
        raw = {t: n * weight[t] for t, n in Counter(text.split()).items() if t in weight}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / length for t, x in raw.items()}

    for r in out.collect():
        job = unit(r.job)
        assert r.sim_cv_vaga == pytest.approx(sum(x * job.get(t, 0.0) for t, x in unit(r.cv).items()), abs=1e-12)
    assert "unwrap_udt" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    nothing = encode.SimilarityTfidfModel(jobCol="job", candidateCol="cv", terms=[], idf=[]).transform(df)
    assert [r.sim_cv_vaga for r in nothing.collect()] == [0.0] * 4


def test_compare_models_query_fits_every_tree_and_round(spark, monkeypatch):
    columns = {"rid": "doc_id", "perfil_vaga.nivel_academico": "vaga.nivel", "formacao.nivel": "lang", "modalidade": "source",
               "perfil_vaga.principais_atividades": "vaga.atividades"}
    rows = people(spark).withColumnsRenamed(columns)
    monkeypatch.setattr(model_queries, "training_table", lambda *_: rows)
    asked = {}

    def fits_few(kind, name):
        fit = kind._fit

        def few(self, df):
            asked[name] = self.getOrDefault(name)
            return fit(self.copy({getattr(self, name): 2}), df)

        monkeypatch.setattr(kind, "_fit", few)

    fits_few(models.HistogramBooster, "rounds")
    fits_few(models.BalancedForest, "trees")
    found = {r["model"] for r in model_queries.compare_models(spark, "").collect()}
    assert found == {"LogReg", "RandomForest", "Boosted"} and asked == {"rounds": 300, "trees": 300}
