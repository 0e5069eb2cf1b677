import hashlib
import json

import pytest
from pyspark.sql import functions as F

from screenspark.functions import scalars as S


def test_level_match(spark):
    rows = [(None, None, 1), ("Superior ", "superior", 1), ("a", "b", 0), ("", None, 1), ("\tx", "X\n", 1)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert df.filter(S.level_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize(
    "status, outcome",
    [
        ("Aprovado", "contratado"),
        ("Recusado", "negado"),
        ("Prospect", "em_processo"),
        ("NÃO APROVADO PELO CLIENTE", "negado"),
        (" aprovado", "vazio"),
        (None, "vazio"),
        ("outro", "vazio"),
    ],
)
def test_stage_outcome(spark, status, outcome):
    df = spark.createDataFrame([(status,)], "s string")
    assert df.select(S.stage_outcome(F.col("s"))).first()[0] == outcome


def test_normalized_id(spark):
    rows = [(" 123.0 ", "123"), ("nan", ""), ("None", ""), (None, ""), ("a.0b", "a.0b"), ("12.50", "12.50"), ("\u00a0x\u2003", "x")]
    df = spark.createDataFrame(rows, "i string, want string")
    assert df.filter(S.normalized_id(F.col("i")) != F.col("want")).count() == 0
    floats = spark.createDataFrame([(7.0,), (11225000.0,), (1e9,)], "x double").select(S.normalized_id(F.col("x")))
    assert [r[0] for r in floats.collect()] == ["7", "11225000", "1000000000"]


def test_merged_maps_let_the_candidate_win_even_with_null(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "j map<string,string>, c map<string,string>")
    assert df.select(S.merged_maps(F.col("j"), F.col("c"))).first()[0] == {"a": "1", "b": None, "c": "3"}


def test_input_signature_hashes_key_sorted_json(spark):
    features = {"b": 'x "y"', "a": "1\n2", "c": None, "back": "a\\b"}
    df = spark.createDataFrame([(features,)], "m map<string,string>")
    want = hashlib.sha256(json.dumps(features, sort_keys=True).encode()).hexdigest()[:16]
    assert df.select(S.input_signature(F.col("m"))).first()[0] == want


def test_coercion(spark):
    rows = [("10", "M", "ola"), ("20", None, None), (None, "F", "mundo"), ("x", "F", "")]
    df = spark.createDataFrame(rows, "idade string, sexo string, cv_pt string")
    out = S.coerced(df, numbers=["idade", "ausente"], categories=["sexo"], texts=["cv_pt"])
    assert dict(out.dtypes)["idade"] == "double"
    assert [tuple(r) for r in out.collect()] == [
        (10.0, "M", "ola"),
        (20.0, "", ""),
        (None, "F", "mundo"),
        (None, "F", ""),
    ]


def test_coercion_by_content(spark):
    rows = [("10", "1", "-2.5", None, "1"), (None, "x", "3", None, "2\n")]
    df = spark.createDataFrame(rows, "idade string, misto string, nota string, nada string, linha string")
    out = S.coerced_by_content(df)
    kinds = {"idade": "double", "misto": "string", "nota": "double", "nada": "string", "linha": "string"}
    assert dict(out.dtypes) == kinds
    assert [tuple(r) for r in out.collect()] == [(10.0, "1", -2.5, "", "1"), (None, "x", 3.0, "", "2\n")]
    declared = S.coerced_by_content(df, categories=["idade"])
    assert [r.idade for r in declared.collect()] == ["10", ""]


def test_filled(spark):
    df = spark.createDataFrame([(None, None)], "cv string, n double")
    assert tuple(S.filled(df, texts=["cv"]).first()) == ("", 0.0)


def test_compact_json_drops_nulls_and_types_values(spark):
    df = spark.createDataFrame([("x", 3, None)], "a string, n int, z string")
    assert df.select(S.compact_json(df, ["a", "n", "z"])).first()[0] == '{"a":"x","n":3.0}'


def test_threshold_label(spark):
    df = spark.createDataFrame([(0.6,), (0.59,)], "p double")
    assert [r[0] for r in df.select(S.threshold_label(F.col("p"))).collect()] == [1, 0]


def test_only_plain_numbers_are_read(spark):
    rows = [("10d",), ("1f",), ("nan",), ("inf",), (" 12 ",), ("-1.5e3",), (".5",), ("5.",), ("x",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(S.read_number(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [None, None, None, None, 12.0, -1500.0, 0.5, 5.0, None, None, None]


def test_null_maps_merge_as_empty(spark):
    df = spark.createDataFrame([({"a": "1"}, None), (None, {"b": "2"}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(S.merged_maps(F.col("x"), F.col("y"))).collect()] == [{"a": "1"}, {"b": "2"}, {}]


def test_job_profile_fields_stay_text(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "`perfil_vaga.anos` int, nota double, t string")
    text = df.select(S.compact_json(df, df.columns)).first()[0]
    assert json.loads(text) == {"perfil_vaga.anos": "1", "nota": 2.5, "t": "x"}
