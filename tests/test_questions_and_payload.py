import json

import pytest
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.operators import payload, questions, ranking


def reply(spark, text, ids):
    df = spark.createDataFrame([(text, ids)], "reply string, ids array<string>")
    common, each = questions.normalized_reply(F.col("reply"), F.col("ids"))
    return tuple(df.select(common.alias("c"), each.alias("e")).first())


def test_valid_reply(spark):
    text = 'Claro: {"common_questions": ["Q1"], "per_candidate": {"c99": ["P1"]}} pronto'
    assert reply(spark, text, ["c99"]) == (["Q1"], {"c99": ["P1"]})


def test_reply_lists_are_cut_and_foreign_ids_dropped(spark):
    text = json.dumps({"common_questions": list("abcdefg"), "per_candidate": {"c1": list("wxyz"), "z": ["q"]}})
    assert reply(spark, text, ["c1", "c2"]) == (list("abcde"), {"c1": list("wxy"), "c2": []})


def test_unreadable_reply_gives_empty_lists(spark):
    for text in ("não-json", "", None, "{quebrado"):
        assert reply(spark, text, ["c1"]) == ([], {"c1": []})


def test_prompt(spark):
    jobs = spark.createDataFrame(
        [("v1", "", "Descrição", "Req"), ("v2", "Ativ", None, None)],
        f"codigo_vaga string, `{fixed.JOB_ACTIVITIES}` string, descricao string, `{fixed.JOB_SKILLS}` string",
    )
    ranked = spark.createDataFrame(
        [("v1", "b", "cv b", 2), ("v1", "a", "x" * 3000, 1), ("v2", None, None, 1)],
        "codigo_vaga string, external_id string, cv string, rank int",
    )
    fields = questions.prompt_fields(jobs, "codigo_vaga")
    rows = questions.prompt_texts(ranked, fields, "codigo_vaga", "external_id", "cv", "rank").collect()
    found = {r.codigo_vaga: r.prompt.split("\n") for r in rows}
    head = list(fixed.PROMPT_HEAD)
    assert found["v1"] == [
        *head, "Descricao: Descrição", "Requisitos: Req", "", "CANDIDATOS:",
        "- id=a: " + "x" * 2000 + "...", "- id=b: cv b", "", fixed.PROMPT_TAIL,
    ]
    assert found["v2"] == [
        *head, "Descricao: Ativ", "Requisitos: ", "Atividades: Ativ", "", "CANDIDATOS:", "- id=sem_id: ", "",
        fixed.PROMPT_TAIL,
    ]


def test_prompt_refuses_uncut_candidates(spark):
    jobs = spark.createDataFrame([("v1", "d", "r", "a")], "codigo_vaga string, descricao string, requisitos string, atividades string")
    ranked = spark.range(1500).select(F.lit("v1").alias("codigo_vaga"), "id", F.lit("cv").alias("cv"), (F.col("id") + 1).alias("rank"))
    with pytest.raises(Exception, match="cut the candidates"):
        questions.prompt_texts(ranked, jobs, "codigo_vaga", "id", "cv", "rank").collect()


def base(spark):
    rows = [
        ("7.0", "c2", 0, "cv dois", "Desenvolver", 5.0),
        ("7.0", "c1", 1, 'cv "um"', "Outra", None),
        ("7.0", "c1", 2, "repetido", "Outra", 1.0),
        ("8", "c9", 3, None, None, 2.0),
    ]
    return spark.createDataFrame(
        rows,
        "codigo_vaga string, codigo_applicant string, pos int, cv_pt string, "
        "`perfil_vaga.principais_atividades` string, nota double",
    )


def test_payload_documents(spark):
    out = payload.job_payloads(
        base(spark), "pos", ["perfil_vaga.principais_atividades", "ausente"], ["cv_pt", "nota"], top_n=5
    )
    found = {r.codigo_vaga: json.loads(r.payload) for r in out.collect()}
    assert found == {
        "7": {
            "vaga": {"perfil_vaga.principais_atividades": "Desenvolver"},
            "candidatos": [
                {"meta": {"external_id": "c1"}, "candidato": {"cv_pt": 'cv "um"'}},
                {"meta": {"external_id": "c2"}, "candidato": {"cv_pt": "cv dois", "nota": 5.0}},
            ],
        },
        "8": {"vaga": {}, "candidatos": [{"meta": {"external_id": "c9"}, "candidato": {"nota": 2.0}}]},
    }
    cut = payload.job_payloads(base(spark), "pos", [], ["cv_pt"], top_n=1)
    assert {r.codigo_vaga: r.n_candidates for r in cut.collect()} == {"7": 1, "8": 1}


def test_uncut_payload_rows_hold_every_candidate(spark):
    rows = payload.payload_rows(base(spark), "pos", ["perfil_vaga.principais_atividades"], ["cv_pt"]).collect()
    assert {(r.codigo_vaga, r.external_id) for r in rows} == {("7", "c1"), ("7", "c2"), ("8", "c9")}


def test_ids_without_candidate_column_come_from_the_position(spark):
    df = base(spark).drop("codigo_applicant")
    assert ranking.candidate_column(df) is None
    rows = payload.candidate_rows(df, "pos", ["nota"]).collect()
    assert {r.external_id for r in rows} == {"0", "1", "2", "3"}


def test_two_missing_ids_are_one_entry(spark):
    reply = '{"common_questions": ["c"], "per_candidate": {"sem_id": ["q"]}}'
    df = spark.createDataFrame([(reply, [None, "a", None, "a"])], "reply string, ids array<string>")
    common, each = questions.normalized_reply(F.col("reply"), F.col("ids"))
    row = df.select(common.alias("c"), each.alias("e")).first()
    assert row.c == ["c"] and row.e == {"sem_id": ["q"], "a": []}
