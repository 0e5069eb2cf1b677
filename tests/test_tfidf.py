import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from screenspark.functions.text import stop_words
from screenspark.operators import tfidf


def plain(c):
    return F.filter(F.split(c, " "), lambda w: w != "")


def texts(spark, *values):
    return spark.createDataFrame([(v, 1) for v in values], "text string, weight long")


def test_idf_of_three_documents(spark):
    spec = tfidf.TfidfSpec(max_features=10, words=plain)
    vocab = {r.term: r for r in tfidf.vocabulary(texts(spark, "a b", "a", "c"), spec).collect()}
    assert vocab["a"].idf == pytest.approx(math.log(4 / 3) + 1)
    assert vocab["b"].idf == vocab["c"].idf == pytest.approx(math.log(4 / 2) + 1)
    assert [vocab[t].pos for t in "abc"] == [0, 1, 2]


def test_bounds_are_inclusive_and_come_before_the_cut(spark):
    docs = texts(spark, *["a b x"] * 3, *["a b"] * 6, "a z z z z z z z z z z z")
    spec = tfidf.TfidfSpec(max_features=2, min_df=3, max_df=0.9, words=plain)
    # a is in 10 of 10, b in 9 of 10 (kept), x in 3 (kept), z in one (dropped although frequent).
    assert {r.term for r in tfidf.vocabulary(docs, spec).collect()} == {"b", "x"}
    tied = tfidf.vocabulary(texts(spark, "d c b a"), tfidf.TfidfSpec(max_features=2, words=plain))
    assert {r.term for r in tied.collect()} == {"a", "b"}


def brute_force(pairs, cands, jobs, size, low, high):
    docs = [t for c, j in pairs for t in (cands[c], jobs[j])]
    df, tf = Counter(), Counter()
    for doc in docs:
        words = doc.split()
        df.update(set(words))
        tf.update(words)
    kept = [w for w in df if low <= df[w] <= high * len(docs)]
    kept = sorted(kept, key=lambda w: (-tf[w], w))[:size]
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in kept}

    def vec(doc):
        v = {w: n * idf[w] for w, n in Counter(doc.split()).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    return {
        (c, j): sum(x * vec(jobs[j]).get(w, 0.0) for w, x in vec(cands[c]).items()) for c, j in pairs
    }


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_similarity_equals_brute_force_with_a_hot_job(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfg" for b in "klmnp"]
    words = [w for w in words if w not in stop_words()]
    text = lambda n: " ".join(rng.choices(words, k=n))
    cands = {i: text(rng.randrange(0, 30)) for i in range(60)}
    jobs = {j: text(rng.randrange(1, 15)) for j in range(5)}
    pairs = sorted({(c, 0 if rng.random() < 0.4 else rng.randrange(5)) for c in list(cands) * 2})
    frame = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} int, text string")
    spec = tfidf.TfidfSpec(max_features=15, min_df=3, max_df=0.9)
    got = tfidf.similarity(
        spark.createDataFrame(pairs, "c int, j int"), frame(cands, "c"), frame(jobs, "j"), "j", "c", spec
    ).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    want = brute_force(pairs, cands, jobs, 15, 3, 0.9)
    assert len(got) == len(want)
    for r in got:
        assert r.sim_cv_vaga == pytest.approx(want[(r.c, r.j)], abs=1e-12)


def test_weights_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a"), (3, "")], "id int, text string")
    spec = tfidf.TfidfSpec(max_features=10, words=plain)
    vocab = tfidf.vocabulary(docs.select("text", F.lit(1).alias("weight")), spec)
    rows = tfidf.weights(docs, "id", vocab, spec).groupBy("id").agg(F.sum(F.col("w") ** 2).alias("s")).collect()
    assert {r.id: round(r.s, 12) for r in rows} == {1: 1.0, 2: 1.0}


def test_vocabulary_size_is_checked():
    with pytest.raises(ValueError):
        tfidf.TfidfSpec(max_features=10**9)


def test_absent_texts_count_as_documents(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "c long, j long")
    cvs = spark.createDataFrame([(1, "sap java"), (2, "sap nuvem")], "c long, text string")
    jobs = spark.createDataFrame([(1, "sap")], "j long, text string")
    spec = tfidf.TfidfSpec(max_features=10, words=plain)
    found = {r.term: r for r in tfidf.pair_vocabulary(pairs, cvs, jobs, "j", "c", spec).collect()}
    assert found["sap"].df == 5 and found["sap"].idf == pytest.approx(math.log(7 / 6) + 1)
    assert found["java"].idf == pytest.approx(math.log(7 / 2) + 1)


def test_no_filter_counts_the_terms_below_the_exchange(spark):
    docs = spark.range(40).select("id", F.concat_ws(" ", F.lit("alpha beta"), F.col("id").cast("string")).alias("text"))
    vocab = tfidf.vocabulary(docs.select("text", F.lit(1).alias("weight")), tfidf.TfidfSpec(max_features=9, words=plain))
    for df in (
        tfidf.term_statistics(tfidf.spread_if_small(docs).select("text", F.lit(1).alias("weight")), tfidf.SIMILARITY),
        tfidf.vectors(docs, "id", vocab, tfidf.SIMILARITY),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
        assert "Repartition" in plan and "Generate explode" in plan
        assert not any("size(" in f for f in filters)
