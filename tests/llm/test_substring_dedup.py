import hashlib

import numpy as np

from screenspark.llm import substring_dedup
from tests.llm.helpers import docs_frame, random_docs, same_rows


def slow(rows, window):
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    big = 1 << 62
    for i, words in docs:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for i, words in docs:
        gone = set()
        for a in range(len(words) - window + 1):
            if least[tuple(words[a : a + window])] < (big if i is None else i):
                gone.update(range(a, a + window))
        kept = [w for a, w in enumerate(words) if a not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_removal_equals_brute_force(spark):
    rows = random_docs(vocabulary=4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, f"a{i} {passage} b{i}", None, None, 0) for i in range(80)]
    got = substring_dedup.remove_repeated_windows(docs_frame(spark, rows), window=5)
    assert same_rows(substring_dedup.digest(got).collect(), slow(rows, 5))
    fifty = substring_dedup.remove_repeated_windows(docs_frame(spark, rows))
    assert same_rows(substring_dedup.digest(fifty).collect(), slow(rows, 50))
    spans = [r for r in fifty.collect() if r["doc_id"] == 2001][0]["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(1, 61)]


def test_window_hashes_depend_on_words_alone():
    words = np.array([5, 7, 9, 5, 7, 9, 5], np.uint64)
    found = substring_dedup.window_hashes(words, 3)
    assert found[0] == found[3] and found[1] == found[4] and len(set(found.tolist())) == 3


def test_empty_table(spark):
    assert substring_dedup.remove_repeated_windows(docs_frame(spark, [])).collect() == []
