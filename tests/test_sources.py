import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.sources import keyed_json as kj
from screenspark.sources import tables


def documents(spark, *objects):
    return spark.createDataFrame([(json.dumps(o, ensure_ascii=False),) for o in objects], "value string")


def record(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_flatten_gives_one_row_per_key(spark):
    docs = documents(spark, {"123": {"nome": "Carlos"}, "456": {"nome": "Ana"}})
    rows = kj.flatten_keyed_json(docs, record("nome"), "codigo").collect()
    assert {(r.codigo, r.nome) for r in rows} == {("123", "Carlos"), ("456", "Ana")}


def test_flatten_of_empty_object_is_empty(spark):
    assert kj.flatten_keyed_json(documents(spark, {}), record("nome"), "codigo").count() == 0


def test_flatten_keeps_null_fields(spark):
    rows = kj.flatten_keyed_json(documents(spark, {"1": {"campo": None}}), record("campo"), "id").collect()
    assert [(r.id, r.campo) for r in rows] == [("1", None)]


def test_flatten_names_nested_fields_with_dots_and_blanks(spark):
    schema = T.StructType(
        [
            T.StructField("perfil_vaga", record("nivel profissional", "cidade")),
            T.StructField("lista", T.ArrayType(T.StringType())),
        ]
    )
    docs = documents(spark, {"7": {"perfil_vaga": {"nivel profissional": "Pleno"}, "lista": ["a", "b"]}})
    df = kj.flatten_keyed_json(docs, schema, "codigo_vaga")
    assert df.columns == ["codigo_vaga", "perfil_vaga.nivel profissional", "perfil_vaga.cidade", "lista"]
    assert tuple(df.first()) == ("7", "Pleno", None, ["a", "b"])


def test_schema_is_found_when_not_given(spark):
    docs = documents(spark, {"1": {"a": "x", "n": {"b": 2}}}, {"2": {"a": "y", "c": None, "n": {"b": 3}}})
    df = kj.flatten_keyed_json(docs, kj.keyed_json_schema(docs), "id")
    assert set(df.columns) == {"id", "a", "c", "n.b"}
    assert {(r["id"], r["a"], r["n.b"]) for r in df.collect()} == {("1", "x", 2), ("2", "y", 3)}


def test_broken_document_is_an_error(spark):
    docs = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        kj.flatten_keyed_json(docs, record("a"), "id").collect()


def test_prospects_repeat_the_job_header(spark):
    jobs = {"v1": {"titulo": "Dev", "modalidade": "remoto", "prospects": [{"codigo": "c1"}, {"codigo": "c2"}]}}
    rows = kj.load_prospects(documents(spark, jobs)).collect()
    assert {(r.codigo_vaga, r.titulo_vaga, r.codigo_applicant) for r in rows} == {
        ("v1", "Dev", "c1"),
        ("v1", "Dev", "c2"),
    }


def test_jobs_without_prospects_give_no_row(spark):
    jobs = {"v1": {"titulo": "Dev"}, "v2": {"titulo": "QA", "prospects": []}}
    assert kj.load_prospects(documents(spark, jobs)).count() == 0


def test_absent_prospect_fields_are_null_and_stage_is_renamed(spark):
    jobs = {"v": {"prospects": [{"codigo": "c1", "nome": "Ana", "situacao_candidado": "Aprovado"}]}}
    row = kj.load_prospects(documents(spark, jobs)).first()
    assert (row.situacao_candidato, row.comentario, row.titulo_vaga) == ("Aprovado", None, None)


def test_read_documents_whole_and_by_line(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"1": {"a": "x"},\n "2": {"a": "y"}}')
    (tmp_path / "lines.json").write_text('{"1": {"a": "x"}}\n{"2": {"a": "y"}}\n')
    for name, lines in (("one.json", False), ("lines.json", True)):
        docs = kj.read_documents(spark, str(tmp_path / name), lines)
        assert kj.flatten_keyed_json(docs, record("a"), "id").count() == 2


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("1", 'diz "oi",\nadeus'), ("2", None)], "id string, cv string")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    back = tables.read_table(spark, str(tmp_path / "t.csv"), "id string, cv string")
    assert sorted(map(tuple, back.collect())) == [("1", 'diz "oi",\nadeus'), ("2", None)]


def test_parquet_keeps_odd_names(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "`perfil_vaga.nivel profissional` string")
    tables.write_parquet(df, str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).columns == df.columns


def test_json_table_in_both_layouts(spark, tmp_path):
    (tmp_path / "doc.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "rows.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.read_json_table(spark, str(tmp_path / "doc.json")).count() == 2
    assert tables.read_json_table(spark, str(tmp_path / "rows.json"), lines=True).count() == 2


def test_json_sink_writes_one_document_per_row(spark, tmp_path):
    tables.write_json(spark.range(3), str(tmp_path / "out"))
    texts = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(texts) == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_feature_map_strict_and_lenient(spark, tmp_path):
    good, bad = tmp_path / "fm.json", tmp_path / "bad.json"
    good.write_text('{"text": ["cv_pt"]}')
    bad.write_text("{oops")
    assert tables.load_feature_map(spark, str(good)) == {"text": ["cv_pt"]}
    assert "id" in tables.missing_roles({"text": []})
    with pytest.raises(FileNotFoundError):
        tables.load_feature_map(spark, str(tmp_path / "none.json"))
    assert tables.load_feature_map(spark, str(tmp_path / "none.json"), strict=False) == {}
    with pytest.raises(RuntimeError):
        tables.load_feature_map(spark, str(bad), strict=False)


def test_keyed_document_round_trip(spark):
    docs = spark.range(3).select(
        kj.keyed_document(F.col("id"), F.struct(F.lit(None).cast("string").alias("a"))).alias("value")
    )
    rows = kj.flatten_keyed_json(docs, record("a"), "id").collect()
    assert sorted((r.id, r.a) for r in rows) == [("0", None), ("1", None), ("2", None)]


def test_schema_words_in_names_stay(spark):
    base = {"1": {"VOID": None, "OBJECT<x": {"a VOID b": 1}, "n": [None], "k": {"VOID": 2}}}
    docs = documents(spark, base)
    found = kj.keyed_json_schema(docs)
    assert set(found.names) == {"VOID", "OBJECT<x", "n", "k"}
    assert found["k"].dataType.names == ["VOID"] and found["OBJECT<x"].dataType.names == ["a VOID b"]
    assert found["VOID"].dataType.simpleString() == "string" and found["n"].dataType.simpleString() == "array<string>"


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(200).selectExpr("cast(id % 50 as string) AS job", "id AS n")
    right = spark.range(40).selectExpr("cast(id as string) AS job", "id * 2 AS m")
    tables_ = [tables.write_bucketed(d, f"bucketed_{i}", "job", 4, str(tmp_path / str(i))) for i, d in enumerate((left, right))]
    joined = tables_[0].join(tables_[1].hint("merge"), "job", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, left.join(right, "job", "left").collect()), key=str)
