import itertools
import random

import pytest
import xxhash

from screenspark.llm import simhash
from tests.llm.helpers import docs_frame, random_docs


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, max_bits):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(sorted(nodes), 2):
        if (a ^ b).bit_count() <= max_bits:
            parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_groups_equal_brute_force(spark):
    rows = random_docs()
    groups = simhash.near_groups(docs_frame(spark, rows))
    got = groups.select("doc_id", "fingerprint", "component_id").collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    root = slow_components(set(fps), 4)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = [(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 30])
def test_links_of_dense_balls_span_all_components(spark, limit):
    pick = random.Random(5)
    fps = {pick.getrandbits(64) for _ in range(300)}
    for center in (0, pick.getrandbits(64)):
        fps |= {center ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 5))) for _ in range(400)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, limit).collect()
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert all((a ^ b).bit_count() for a, b in pairs)
    parent = {f: f for f in fps}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    want = slow_components(fps, 4)
    same = {}
    for f in fps:
        assert same.setdefault(root(f), want[f]) == want[f]
    assert len(same) == len(set(want.values()))


def test_one_row_of_each_group_stays(spark):
    rows = random_docs()
    docs = docs_frame(spark, rows)
    got = simhash.one_per_group(docs)
    assert got.columns == docs.columns
    fps = [slow_fingerprint(r[1]) for r in rows]
    root = slow_components(set(fps), 4)
    least = {}
    for r, f in zip(rows, fps):
        least.setdefault(root[f], set()).add(r[0])
    want = [min((i for i in ids if i is not None), default=None) for ids in least.values()]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert simhash.near_groups(docs_frame(spark, [])).collect() == []
