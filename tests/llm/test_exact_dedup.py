import hashlib

import pytest

from screenspark.llm import exact_dedup
from screenspark.llm.common import LOWER, UPPER
from tests.llm.helpers import docs_frame, random_docs, same_rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_equal_brute_force(spark, keep):
    rows = random_docs()
    rows += [(1000 + i, "HOT copy" if i % 2 else "hot COPY", None, "s", 0) for i in range(300)]
    norm = [(r[1] or "").translate(str.maketrans(UPPER, LOWER)) for r in rows]
    groups = {}
    for r, n in zip(rows, norm):
        groups.setdefault(n, []).append(r[0])
    pick = {"smallest": min, "largest": max}[keep]
    best = {n: pick((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    want = [
        (r[0], best[n], len(groups[n]), r[0] == best[n], hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(rows, norm)
    ]
    got = exact_dedup.exact_groups(docs_frame(spark, rows), keep=keep).collect()
    assert same_rows(got, want)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(docs_frame(spark, [])).collect() == []


def test_long_shared_beginnings_are_told_apart(spark):
    rows = [(i, "head " * 50 + str(i // 2), None, None, 0) for i in range(60)]
    got = exact_dedup.exact_groups(docs_frame(spark, rows)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, i - i % 2, 2) for i in range(60)}
