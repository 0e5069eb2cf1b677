import hashlib
import math
import re
import zlib
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from screenspark.llm import byte_words, resampling
from tests.llm.helpers import docs_frame, random_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_force(docs, target):
    """(doc_id, n_features, weight, score, rank) by the definition, one document after the other."""
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s_all, t_all = float(raw.total() + 10_000), float(wanted.total() + 10_000)

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((raw[b] + 1) * t_all)))

    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([n, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    ranks = [(r, i + 1) for i, r in enumerate(able[: 5 * len(able) // 100])]
    drawn = {id(r): i for r, i in ranks}
    return [(*r[1:], drawn.get(id(r))) for r in rows]


def same(spark, rows, target):
    targets = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, weight string")
    got = resampling.resample(docs_frame(spark, rows), targets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_force([r[:2] for r in rows], target), key=repr)


def test_equals_brute_force_with_odd_rows_and_repeated_rows(spark):
    same(spark, random_docs(150, lines=40) + [(900, "À-É_ß ÀÉSS1", "x", "y", 1), (901, "日本 語 " * 30, None, None, 0)], ["w1 w2 w3", None, "W1, w2!", "日本 語"])


def test_without_target_texts_and_without_documents(spark):
    same(spark, random_docs(60, lines=40), [])
    same(spark, [], ["a"])
    same(spark, [(1, None, None, None, None)], [None])


def test_many_equal_scores_are_cut_by_id(spark):
    weighed = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(20).cast("long").alias("n_words"), F.lit(5).cast("long").alias("n_features"), F.lit(7).cast("long").alias("weight"), (F.col("id") % 3).alias("score"))
    got = resampling.drawn(weighed, percent=50).filter("rank is not null").orderBy("rank").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 3), i))[:500]
    assert [(r["rank"], r["doc_id"]) for r in got] == list(enumerate(want, 1))
    assert resampling.drawn(weighed, percent=100).filter("rank is null").count() == 0
    assert resampling.drawn(weighed, percent=0).filter("rank is not null").count() == 0


@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
def test_runs_go_on_across_slices_of_a_text(monkeypatch, size):
    monkeypatch.setattr(resampling, "word_slices", partial(byte_words.word_slices, size=size))
    text = "Ab c, dé 12  ab c--x " * 7
    found = [c % 10_000 for _, codes in resampling.feature_codes(text.encode()) for c in codes]
    assert sorted(found) == sorted(features(text)[1])


def test_more_documents_like_the_target_are_drawn(spark):
    rows = [(i, " ".join(f"{'news' if i % 10 == 0 else 'spam'}{(i * 7 + j) % 13}" for j in range(30)), "en", "s", 0) for i in range(1000)]
    target = spark.createDataFrame([(1, " ".join(f"news{j % 13}" for j in range(200)))], "item_id long, text string")
    got = resampling.resample(docs_frame(spark, rows), target).filter("rank is not null")
    assert got.count() == 50 and got.filter("doc_id % 10 = 0").count() == 50
