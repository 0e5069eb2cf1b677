import random

import pytest
from pyspark.sql import functions as F

from screenspark.operators import joins, shape
from screenspark.operators.models import require_columns
from screenspark.sources import keyed_json as kj

EXPECTED_COLUMNS = {
    "codigo_vaga", "modalidade", "titulo", "codigo_applicant", "nome_candidato", "situacao_candidato",
    "data_candidatura", "ultima_atualizacao", "comentario", "recrutador", "nome", "email",
}


def keyed(spark, text, ddl, id_col):
    docs = spark.createDataFrame([(text,)], "value string")
    schema = spark.createDataFrame([], ddl).schema
    return kj.flatten_keyed_json(docs, schema, id_col)


def test_joined_columns_of_the_three_bases(spark):
    jobs = keyed(spark, '{"vaga1": {"titulo": "Dev", "modalidade": "remoto"}}', "titulo string, modalidade string", "codigo_vaga")
    people = keyed(spark, '{"c1": {"nome": "Ana", "email": "a@b.c"}}', "nome string, email string", "codigo_applicant")
    prospects = kj.load_prospects(
        spark.createDataFrame(
            [('{"vaga1": {"titulo": "Dev II", "modalidade": "x", "prospects": '
              '[{"codigo": "c1", "nome": "Ana", "situacao_candidado": "ok"}]}}',)],
            "value string",
        )
    )
    out = joins.join_screening_tables(jobs, prospects, people)
    assert set(out.columns) == EXPECTED_COLUMNS and len(out.columns) == len(EXPECTED_COLUMNS)
    row = out.first()
    assert (row.titulo, row.modalidade, row.nome) == ("Dev II", "remoto", "Ana")


def test_jobs_without_prospects_and_unknown_applicants_stay(spark, no_broadcast):
    jobs = spark.createDataFrame([("1", "a"), ("2", "b")], "codigo_vaga string, titulo string")
    links = spark.createDataFrame(
        [("1", "t", "x"), ("1", "t", None), ("9", "t", "x")],
        "codigo_vaga string, titulo_vaga string, codigo_applicant string",
    )
    people = spark.createDataFrame([("y", "Ana")], "codigo_applicant string, nome string")
    got = joins.join_screening_tables(jobs, links, people)
    found = sorted(((r.codigo_vaga, r.titulo, r.codigo_applicant, r.nome) for r in got.collect()), key=str)
    assert found == sorted(
        [("1", "t", "x", None), ("1", "t", None, None), ("2", None, None, None)], key=str
    )


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_side_is_joined_without_salt(spark):
    many, one = spark.range(100).toDF("k"), spark.range(5).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    plan = joins.skew_join(many, one, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "salt" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, no_broadcast, how):
    rng = random.Random(3)
    # One key holds a third of the rows, some rows have no key, some keys no partner.
    keys = [0] * 400 + [rng.randrange(1, 60) for _ in range(700)] + [None] * 100
    many = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 50)] + [(7, "twice")], "k int, v string")
    got = sorted(map(str, joins.skew_join(many, one, "k", how).select("id", "k", "v").collect()))
    want = sorted(map(str, many.join(one, "k", how).select("id", "k", "v").collect()))
    assert got == want


def test_hot_key_is_spread_over_partitions(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    hot = {r.hot_key: r.slices for r in joins.hot_keys(many, "k").collect()}
    assert set(hot) == {0} and hot[0] == 2  # a third of the rows fills 1.33 of 4 partitions
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        hot = {r.hot_key: r.slices for r in joins.hot_keys(many, "k").collect()}
        assert set(hot) == {0} and 21 <= hot[0] <= 23
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_left_join_many_equals_a_plain_left_join(spark, no_broadcast):
    one = spark.createDataFrame([(k, f"o{k}") for k in range(20)], "k int, o string")
    many = spark.createDataFrame([(0, i) for i in range(200)] + [(i % 15, i) for i in range(300)] + [(None, 1)], "k int, m int")
    got = sorted(map(str, joins.left_join_many(one, many, "k").collect()))
    assert got == sorted(map(str, one.join(many, "k", "left").select("k", "o", "m").collect()))


def test_left_join_counts(spark):
    base = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    extra = spark.createDataFrame([("a", 2)], "k string, h long")
    rows = joins.left_join_counts(base, extra, "k", ["h"]).collect()
    assert {(r.k, r.n, r.h) for r in rows} == {("a", 3, 2), ("b", 1, 0)}


def test_screening_rules(spark):
    rows = [("Aprovado",), ("Recusado",), ("Prospect",), ("Inscrito",), (None,), ("Entrevista Técnica",)]
    df = spark.createDataFrame(rows, "situacao_candidato string")
    kept = shape.screening_rows(shape.without_first_stages(shape.with_outcome(df))).collect()
    assert {(r.situacao_candidato, r.target_triagem) for r in kept} == {
        ("aprovado", 1),
        ("recusado", 0),
        ("entrevista técnica", 1),
    }
    hired = shape.hiring_rows(shape.with_outcome(df)).collect()
    assert {(r.situacao_candidato, r.target_contratacao) for r in hired} == {("aprovado", 1), ("recusado", 0)}


def test_drop_roles_reports_absent_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, d int")
    out, absent = shape.drop_roles(df, {"id": ["b.c", "x"], "date": ["d"], "text": ["a"]})
    assert out.columns == ["a"] and absent == ["x"]


def test_align_and_warnings(spark):
    df = spark.createDataFrame([({"cv": "t", "extra": "1"},)], "f map<string,string>")
    found = df.select(
        *shape.align_map(F.col("f"), ["sexo", "cv"]),
        *[c.alias(n) for n, c in shape.schema_warnings(F.col("f"), ["sexo", "cv"]).items()],
        *[c.alias(n) for n, c in shape.schema_warnings(F.col("f"), ["sexo", "cv"], "summary").items()],
    ).first()
    assert found.asDict() == {
        "sexo": None, "cv": "t", "missing": ["sexo"], "unknown": ["extra"], "missing_count": 1, "unknown_count": 1,
    }
    assert shape.schema_warnings(F.col("f"), ["a"], "off") == {}
    wide = shape.align(spark.createDataFrame([(1, 2)], "b int, z int"), ["a", "b"])
    assert wide.columns == ["a", "b"] and tuple(wide.first()) == (None, 1)


def test_warning_lists_are_cut_but_counts_are_not(spark):
    df = spark.createDataFrame([({"x": "1"},)], "f map<string,string>")
    names = [f"c{i}" for i in range(50)]
    full = df.select(shape.schema_warnings(F.col("f"), names)["missing"]).first()[0]
    count = df.select(shape.schema_warnings(F.col("f"), names, "summary")["missing_count"]).first()[0]
    assert len(full) == 30 and count == 50


def test_missing_columns_abort(spark):
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(ValueError, match="target_triagem"):
        require_columns(df, ["target_triagem"])


def test_groups_and_target():
    assert shape.groups_and_target(["codigo_vaga", "status_simplificado"], {}) == (["codigo_vaga"], "status_simplificado")
    with pytest.raises(ValueError, match="target"):
        shape.groups_and_target(["codigo_vaga"], {})
    with pytest.raises(ValueError, match="group"):
        shape.groups_and_target(["target_triagem"], {"group": ["outro"]})


def test_classify_features(spark):
    df = spark.createDataFrame([], "id1 string, cv string, nivel string, nota double, nulo string, solto string")
    fmap = {"id": ["id1", "x"], "text": ["cv"], "vaga_info": ["nivel"], "group": []}
    kinds = shape.classify_features(df, fmap, all_null=["nulo"])
    assert (kinds.numbers, kinds.categories, kinds.texts) == (["nota", "nulo"], ["nivel"], ["cv"])
    assert (kinds.excluded, kinds.unmapped) == (["id1"], ["solto"])
    assert kinds.config("feature_map.json", "t.csv")["NUM_CANDIDATES"] == ["nota", "nulo"]
    fallback = shape.classify_by_type(df, fmap)
    assert (fallback.numbers, fallback.categories) == (["nota"], ["nivel", "nulo", "solto"])


def test_job_and_candidate_fields():
    meta = {"schema_in": {"cat": ["modalidade", "perfil_vaga.estado"], "txt": ["cv_pt", "perfil_vaga.demais"]}}
    assert shape.job_and_candidate_fields(meta) == (
        ["perfil_vaga.demais"], ["modalidade", "perfil_vaga.estado", "cv_pt"],
    )
    old = {"features_used": {"num": ["n"], "cat": ["c"], "txt": ["perfil_vaga.x", "cv"]}}
    assert shape.job_and_candidate_fields(old) == (["perfil_vaga.x"], ["n", "c", "cv"])


def test_reorder(spark):
    df = spark.createDataFrame([], "a int, b int, c int, d int")
    assert shape.reorder(df, ["c"], ["a"]).columns == ["c", "b", "d", "a"]
