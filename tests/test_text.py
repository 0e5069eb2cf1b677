import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from screenspark.functions import text as X


def folded(value):
    plain = unicodedata.normalize("NFKD", value.lower().strip()).encode("ascii", "ignore").decode()
    return " ".join(re.sub("[^a-z]+", " ", plain).split())


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "value, want",
    [
        ("Gestão de TI – H2O", "gestao de ti h o"),
        ("  Ação\tÚNICA\n", "acao unica"),
        ("aßb øre", "ab re"),
        ("oﬁcina ½ x", "oficina x"),
        ("", ""),
        ("123", ""),
    ],
)
def test_normalize(spark, value, want):
    assert one(spark, X.normalize_text, value) == want == folded(value)


def test_normalize_agrees_on_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([("a" + chr(c) + "b",) for c in codes], "s string")
    rows = df.select("s", X.normalize_text(F.col("s")).alias("n")).collect()
    assert [r.s for r in rows if r.n != folded(r.s)] == []


def test_stop_words_are_normalised(spark):
    words = X.stop_words()
    assert {"nao", "voce", "ate", "de"} <= set(words) and "não" not in words
    assert list(words) == sorted(words)
    assert len(X.stop_words("spark-ml")) > 100
    with pytest.raises(ValueError):
        X.stop_words("other")


def test_tokens_keep_order_and_repeats(spark):
    assert one(spark, X.tokens, "O gestor de SAP e o SAP Basis") == ["gestor", "sap", "sap", "basis"]
    assert one(spark, X.tokens, None) == []


def test_jaccard(spark):
    assert one(spark, X.skill_overlap, "SAP Basis HANA", "sap, basis") == pytest.approx(2 / 3)
    assert one(spark, X.skill_overlap, "", "sap") == 0.0
    assert one(spark, X.skill_overlap, None, None) == 0.0
    assert one(spark, X.skill_overlap, "de a o", "sap") == 0.0


def test_term_counts_equal_a_counter(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("ab cd ef gh ij".split(), k=n)) for n in (0, 1, 2, 50, 500)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    words = F.filter(F.split("s", " "), lambda w: w != "")
    for row in df.select("s", X.term_counts(words).alias("t")).collect():
        assert {e.term: e.tf for e in row.t} == dict(Counter(row.s.split()))


def test_ngrams(spark):
    got = one(spark, lambda c: X.ngrams(F.split(c, " "), 1, 2), "a b c")
    assert got == ["a", "b", "c", "a b", "b c"]
    assert one(spark, lambda c: X.ngrams(F.split(c, " "), 3, 3), "a b") == []


def test_plain_words_follow_the_unicode_word_rule(spark):
    value = "Ação é C++ a1 _x naïve 日本 x"
    assert one(spark, X.plain_words, value) == re.findall(r"\b\w\w+\b", value.lower())


def test_truncated(spark):
    cut = lambda c: X.truncated(c, 100)
    assert one(spark, cut, "a" * 2000) == "a" * 100 + "..."
    assert one(spark, cut, "a" * 100) == "a" * 100
    assert one(spark, cut, None) == ""


def test_json_block(spark):
    block = one(spark, X.json_block, 'texto {"perguntas": ["Q1", "Q2"]} fim')
    assert block == '{"perguntas": ["Q1", "Q2"]}'
    assert one(spark, X.json_block, "isso não é json válido") == "isso não é json válido"
    assert one(spark, X.json_block, ' {"a": 1}\n') == '{"a": 1}'
    assert one(spark, X.json_block, 'x {"a":\n1} y {"b": 2} z') == '{"a":\n1} y {"b": 2}'


def test_join_texts(spark):
    joined = lambda a, b, c: X.join_texts([a, b, c])
    assert one(spark, joined, "a", None, "c") == "a  c"
    assert spark.range(1).select(X.join_texts([])).first()[0] == ""


def test_word_runs_of_few_words(spark):
    rows = [(["a", "b", "c"],), (["a"],), ([],), (["a", None, "c"],)]
    df = spark.createDataFrame(rows, "w array<string>")
    runs = df.select(X.ngrams(F.col("w"), 2, 3).alias("r"))
    got = [r.r for r in runs.collect()]
    assert got == [["a b", "b c", "a b c"], [], [], ["a", "c", "a c"]]
    assert "slice(" not in runs._jdf.queryExecution().optimizedPlan().toString()
