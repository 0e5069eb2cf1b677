"""Every stage on the odd rows against a brute-force version of itself, and the whole run on a small table."""

import math
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from screenspark.llm import pieces, simhash
from tests.llm.helpers import COLUMNS, docs_frame, random_docs
from tests.llm.test_language_id import slow_known
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_mixing import slow_mix
from tests.llm.test_simhash import slow_components, slow_fingerprint

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS_OF = [c.split()[0] for c in COLUMNS.split(", ")]


@pytest.fixture(scope="module")
def rows():
    return random_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_language_follows_the_rule(spark, rows, docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = slow_known(rows, held)
    share = sorted(b / a for r in rows if r[1] is not None and r[2] is not None and not held(r[0]) for a, b in [known(r[1])] if a)
    need = share[max(0, math.ceil(0.01 * len(share)) - 1)] / 2

    def stays(text):
        n, hits = known(text)
        return hits > 0 and hits >= n * need - 3 * math.sqrt(n * need * (1 - need))

    want = Counter(r for r in rows if stays(r[1]))
    assert Counter(map(tuple, STAGE["language"](spark, docs, "").collect())) == want


@pytest.mark.parametrize("name", [n for n in STAGE if n != "token ids"])
def test_extra_columns_named_like_results_go_through(spark, rows, name):
    docs = docs_frame(spark, rows)
    got = STAGE[name](spark, docs, "")
    assert got.dtypes == docs.dtypes
    extra = docs.columns[len(COLUMNS_OF) :]
    kept = [tuple(r[c] for c in extra) for r in got.collect()]
    assert kept and set(kept) == {tuple("abcdefgh")}


def test_token_ids_decode_to_the_texts(spark, rows, docs):
    got = STAGE["token ids"](spark, docs, "")
    assert got.columns == ["doc_id", "source", "ids", "n_pieces"]
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(got).collect())
    assert back == Counter(r[:2] for r in rows)
    assert all(r["ids"] is None and r["n_pieces"] in (None, -1) or r["n_pieces"] == len(r["ids"]) for r in got.collect())


def test_lines(spark, rows, docs):
    gone = slow_lines(rows)
    want = Counter()
    for r in rows:
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[:2]])
        want[(r[0], kept, *r[2:4], None if kept is None else len(kept))] += 1
    assert Counter(map(tuple, STAGE["line dedup"](spark, docs, "").collect())) == want


def test_near_duplicates(spark, rows, docs):
    root = slow_components({slow_fingerprint(r[1]) for r in rows}, simhash.MAX_BITS)
    got = STAGE["near duplicates"](spark, docs, "").collect()
    assert Counter(root[slow_fingerprint(r["text"])] for r in got) == Counter(set(root.values()))


def test_mixing(spark, rows, docs):
    size, _, _, taken = slow_mix(rows)
    want = Counter()
    for i, r in enumerate(rows):
        if size[i]:
            want[r] += taken[i] // size[i]
    assert Counter(map(tuple, STAGE["mixing"](spark, docs, "").collect())) == +want


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_documents(spark, name):
    empty = spark.createDataFrame([], COLUMNS)
    got = STAGE[name](spark, empty, "")
    assert got.collect() == []
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == empty.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["n_pieces"] == len(r["ids"]) for r in got)
    assert max(Counter(r["doc_id"] for r in got).values()) == 2


def test_language_drops_unseen_scripts_and_keeps_short_clean_texts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    clean = spark.read.parquet(path).select(*COLUMNS_OF)
    words = sorted({w for r in clean.limit(200).collect() for w in (r["text"] or "").split() if w.isalpha() and len(w) > 2})
    pick = random.Random(1)
    scripts = ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξ", "的一是在不了有和人这中大为上个国"]
    unseen = [" ".join("".join(pick.choices(s, k=6)) for _ in range(n)) for s in scripts for n in (1, 20, 300) for _ in range(5)]
    short = pick.choices(words, k=100)
    odd = [(10**9 + i, t, None, "odd", len(t)) for i, t in enumerate(unseen + short)]
    docs = clean.unionByName(spark.createDataFrame(odd, COLUMNS))
    kept = {r["doc_id"] for r in STAGE["language"](spark, docs, "").collect()}
    assert not kept & {r[0] for r in odd[: len(unseen)]}
    assert len(kept & {r[0] for r in odd[len(unseen) :]}) >= 99
    assert len(kept) >= 0.99 * clean.count()
