import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm import quality
from tests.llm.helpers import docs_frame, random_docs, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


ODD = [(500, "#*$%&|<> é日本 | a|b\n a|b\n a|b\na|b\r\na|b\r\n", None, None, 0), (501, "a b c a b c a b", None, None, 0), (502, "x y", None, None, 0)]


def test_counts_equal_brute_force(spark):
    rows = [*random_docs(100, vocabulary=5), *ODD]
    got = quality.statistics(docs_frame(spark, rows)).select("doc_id", *quality.COUNTS).collect()
    assert same_rows(got, [(r[0], *slow_counts(r[1])) for r in rows])


@pytest.mark.parametrize("size", [1, 300])
def test_counts_do_not_depend_on_blocks(spark, monkeypatch, size):
    rows = [*random_docs(40, vocabulary=5), *ODD]
    monkeypatch.setattr(quality.row_blocks, "__defaults__", (size,))
    got = quality.statistics(docs_frame(spark, rows)).select("doc_id", *quality.COUNTS).collect()
    assert same_rows(got, [(r[0], *slow_counts(r[1])) for r in rows])


def slow_path(rows, x, pick, depth, limit):
    """The path length of ``x`` in a tree that is grown as the library grows it, by recursion on the nodes' list."""
    nodes = quality.grown_tree(rows, pick, limit)
    at, steps = 0, 0
    part = rows
    while nodes[at][0] >= 0:
        f, cut, child, _ = nodes[at]
        left = part[:, f] <= cut
        assert left.any() and (~left).any() or cut == part[:, f].min() or cut == part[:, f].max()
        part = part[left] if x[f] <= cut else part[~left]
        at = child if x[f] <= cut else child + 1
        steps += 1
    assert steps <= limit and math.isclose(nodes[at][3], steps + quality.mean_path(len(part)))
    return nodes[at][3]


def test_scores_equal_paths_walked_one_by_one():
    pick = np.random.default_rng(1)
    rows, seen = pick.normal(size=(64, 4)), pick.normal(size=(20, 4)) * 2
    trees = [np.array(quality.grown_tree(rows, np.random.default_rng(t), 6)) for t in range(10)]
    got = quality.forest_scores(trees, seen, 64)
    for x, score in zip(seen, got):
        paths = [slow_path(rows, x, np.random.default_rng(t), 0, 6) for t in range(10)]
        assert math.isclose(score, 2 ** -(np.mean(paths) / quality.mean_path(64)))
    assert quality.forest_scores(trees, np.full((1, 4), 50.0), 64)[0] > got.max()


def junk(i, pick, names):
    words = pick.choices(names, k=pick.randint(80, 200))
    if i % 3 == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + pick.choice(["***", "$$$"]) for w in words) if i % 3 == 1 else "\n".join("| " + w + " |" for w in words)


def labelled(n=600, seed=9):
    pick = random.Random(seed)
    names = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        text = junk(i // 8, pick, names) if bad else ". ".join(" ".join(pick.choices(names, k=pick.randint(6, 14))).capitalize() for _ in range(pick.randint(9, 30)))
        rows.append((i, text, "en", "s", 0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def judged(spark, rows, labels):
    frame = spark.createDataFrame([(*x, "a") for x in labels], "doc_id long, quality int, toxic int, score string")
    return quality.judged_documents(docs_frame(spark, rows), frame)


def test_unlabelled_junk_goes_and_clean_documents_stay(spark):
    rows, labels = labelled()
    seen = {x[0] for x in labels}
    kept = {r["doc_id"]: r["kept"] for r in judged(spark, rows, labels).collect() if r["doc_id"] not in seen}
    bad = [kept[i] for i in kept if i % 8 == 0]
    clean = [kept[i] for i in kept if i % 8]
    assert len(clean) > 100 and np.mean(clean) > 0.95
    assert not bad or np.mean(bad) < 0.1


def test_without_bad_labelled_rows_only_the_base_rules_drop(spark):
    rows = [*random_docs(30), (700, " ".join(f"u{i}" for i in range(60)), "en", "s", 0), (701, "a b c " * 40, "en", "s", 0)]
    for labels in ([], [(None, 1, 0), (700, None, 0)], [(701, 0, 0)], [(700, 1, 0)]):
        got = judged(spark, rows, labels).collect()
        assert len(got) == len(rows)
        for r in got:
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert judged(spark, [], [(1, 1, 0)]).count() == 0


def test_threshold_spends_its_loss_on_good_rows_only(spark):
    good = spark.range(1000).select((F.col("id") / 1000).alias("score"), F.lit(1).alias("quality"))
    bad = spark.range(500).select(F.lit(0.985).alias("score"), F.lit(0).alias("quality"))
    assert 0.984 < quality.threshold(good.unionByName(bad), 0.03) <= 0.985
    assert quality.threshold(good.unionByName(bad), 0.01) > 1
    assert quality.threshold(good, 0.5) > 1
    assert 0.984 < quality.threshold(bad, 0.0) <= 0.985


def test_same_rows_same_forest(spark):
    rows, labels = labelled(200)
    got = [sorted(map(tuple, judged(spark, r, labels).select("doc_id", "score", "kept").collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1]


def test_counts_equal_sql(spark):
    rows = [r for r in random_docs(60, vocabulary=4) if r[0] is not None]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
        want = db.execute(quality.BASE_SQL).fetchall()
    got = quality.statistics(docs_frame(spark, rows)).select("doc_id", *quality.COUNTS).collect()
    assert same_rows(got, want)
