import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from screenspark.llm import language_id as L
from tests.llm.helpers import docs_frame, random_docs


def slow_profile(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    spaced = f" {' '.join(letters.split())} "
    total = np.zeros(L.DIMENSIONS)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        if b != " ":
            v = [L.letter_vector(0 if x == " " else ord(x)).astype(float) for x in (a, b, c)]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return total


def test_profiles_equal_brute_force():
    texts = ["Ab c", "", "12", "École, été!", "日本語 x", " z ", "a" * 50]
    assert np.allclose(L.profiles(texts), [slow_profile(t) for t in texts])


def test_predictions_equal_brute_force(spark):
    rows = random_docs()
    held = lambda i: i is not None and i % 2 == 1
    protos = {}
    for r in rows:
        if r[2] and r[1] and not held(r[0]):
            protos[r[2]] = protos.get(r[2], 0) + slow_profile(r[1])
    names = sorted(protos)
    unit = np.array([protos[n] / np.linalg.norm(protos[n]) for n in names])
    docs = docs_frame(spark, rows)
    got = L.identify(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)), keep=["doc_id", "text", "lang_pred"]).collect()
    assert len(got) == len(rows)
    for r in got:
        p = slow_profile(r["text"] or "")
        if not p.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cosine = unit @ p / np.linalg.norm(p)
            assert abs(r["score"] - max(0, cosine.max())) < 1e-5
            assert cosine[names.index(r["lang_pred"])] > cosine.max() - 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, ~L.held_out(F.col("doc_id")), keep=["doc_id", "lang"]).filter(L.held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_nothing_learned_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "abc", "en", None, 0), (2, None, "en", None, 0)])
    assert {r["lang_pred"] for r in L.identify(docs, F.lit(False)).collect()} == {"und"}
    assert L.identify(docs_frame(spark, []), F.lit(True)).collect() == []


def slow_known(rows, held):
    """Slots of which two labelled rows have a trigram, and per text the numbers of all and of known trigrams."""

    def slots(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        spaced = f" {' '.join(letters.split())} "
        found = [t for t in zip(spaced, spaced[1:], spaced[2:]) if t[1] != " "]
        return [(t, int(L.trigram_slots(np.array([[0 if x == " " else ord(x) for x in t]]))[0])) for t in found]

    count = Counter(s for r in rows if r[1] and r[2] and not held(r[0]) for _, s in set(slots(r[1])))
    return lambda text: (len(slots(text)), sum(count[s] > 1 for _, s in slots(text)))


def test_rows_that_stay_equal_the_rule_by_definition(spark):
    pick = random.Random(7)
    scripts = ["abcdefg", "абвгдежз", "的一是在不了", "qxzjkv"]
    made = lambda s, n: " ".join("".join(pick.choices(s, k=3)) for _ in range(n))
    rows = random_docs(60)
    rows += [(4000 + i, made(scripts[0], 40), "en", None, 0) for i in range(30)]
    rows += [(5000 + i, made(scripts[i % 4], 1 + i % 9 * 5), None, None, 0) for i in range(80)]
    rows += [(6000 + i, made(scripts[0], 3) + " " + made(scripts[1], n), None, None, 0) for i, n in enumerate(range(0, 60, 3))]
    held = lambda i: i is not None and i % 2 == 1
    known = slow_known(rows, held)
    share = sorted(b / a for r in rows if r[1] is not None and r[2] is not None and not held(r[0]) for a, b in [known(r[1])] if a)
    need = share[max(0, math.ceil(0.01 * len(share)) - 1)] / 2
    docs = docs_frame(spark, rows)
    got = L.in_known_languages(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    assert got.dtypes == docs.dtypes

    def stays(text):
        n, hits = known(text)
        return hits > 0 and hits >= n * need - 3 * math.sqrt(n * need * (1 - need))

    want = [(*r, *"abcdefgh") for r in rows if stays(r[1])]
    assert 60 < len(want) < len(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_texts_with_many_letters_are_multiplied_in_blocks(monkeypatch):
    pick = random.Random(2)
    text = "".join(chr(0x4E00 + pick.randrange(20_000)) for _ in range(3000))
    whole = L.profiles([text, "abc", text[:50]])
    monkeypatch.setattr(L, "BLOCK_GRAMS", 7)
    assert np.allclose(L.profiles([text, "abc", text[:50]]), whole)


def test_columns_named_like_the_results_are_kept_by_the_stage(spark):
    rows = [(i, "some clean words here", "en", "s", 0, "mine", "yours", 3, 4) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, known long, trigrams long")
    got = L.in_known_languages(docs, F.lit(True))
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.collect())) == rows
