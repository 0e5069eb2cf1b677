import hashlib
from collections import Counter
from itertools import accumulate

from screenspark.llm import mixing
from tests.llm.helpers import docs_frame, random_docs


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def slow_mix(rows):
    size = [len((r[1] or "").encode().split()) for r in rows]
    sources = Counter()
    for r, n in zip(rows, size):
        sources[r[3]] += n
    target = slow_targets(dict(sources))
    rank = {s: i for i, s in enumerate(sorted((s for s in sources if s is not None)) + [None])}
    place = [hashlib.md5(f"{'' if r[0] is None else r[0]}:7".encode()).hexdigest() for r in rows]
    queue = []
    for s in sources:
        own = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (place[i], rows[i][0] or -1, size[i]))
        for i, upto in zip(own, accumulate(size[i] for i in own)):
            if size[i]:
                queue += [((upto + turn * sources[s]) / target[s], rank[s], upto, i) for turn in (0, 1)]
    taken, total = Counter(), 0
    for finish, _, _, i in sorted(queue):
        total += size[i]
        if total > 1.5 * sum(size):
            break
        taken[i] += size[i]
    return size, sources, target, taken


def test_mix_equals_brute_force(spark):
    rows = random_docs()
    size, sources, target, taken = slow_mix(rows)
    got = mixing.mix(docs_frame(spark, rows)).collect()
    want = Counter((r[0], size[i], sources[r[3]], round(target[r[3]], 6), taken[i]) for i, r in enumerate(rows))
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    given = Counter()
    for r in got:
        given[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    longest = max(size)
    assert all(target[s] - longest <= given[s] <= target[s] + longest for s in sources)


def test_documents_come_as_often_as_they_are_taken(spark):
    rows = random_docs()
    size, _, _, taken = slow_mix(rows)
    docs = docs_frame(spark, rows)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    want = Counter()
    for i, r in enumerate(rows):
        if size[i]:
            want[r[:2]] += taken[i] // size[i]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want


def test_hot_source_and_ranges(spark):
    rows = [(i, "w " * (1 + i % 5), None, "hot" if i % 3 else f"s{i % 7}", 0) for i in range(900)]
    docs = docs_frame(spark, rows)
    few = mixing.mix(docs, ranges=4).select("doc_id", "taken").collect()
    assert sorted(few) == sorted(mixing.mix(docs).select("doc_id", "taken").collect())


def test_empty_tables(spark):
    assert mixing.mix(docs_frame(spark, [])).collect() == []
    assert mixing.mixed_documents(docs_frame(spark, [])).collect() == []
    nothing = mixing.mix(docs_frame(spark, [(1, None, None, None, 0), (2, " ", None, "a", 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
