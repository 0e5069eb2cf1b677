from itertools import takewhile

import pytest

from screenspark.llm import line_dedup
from tests.llm.helpers import docs_frame, random_docs, same_rows


def slow(rows, w=line_dedup.MIN_LINES, long_line=line_dedup.LONG_LINE):
    """Lines that go, per distinct (id, text)."""
    docs = sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    lines = {d: [(i, x) for i, x in enumerate(d[1].split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d in docs}
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        runs = [lines[d][a : a + w] for a in range(len(lines[d]) - w + 1)]
        keys = [(r, tuple(x for _, x in r)) for r in runs]
        keys += [([x], ("long", x[1])) for x in lines[d] if len(x[1]) >= long_line]
        keys += [(lines[d], ("only", lines[d][0][1]))] if len(lines[d]) == 1 else []
        for run, key in keys:
            if key in seen:
                gone[d].update(i for i, _ in run)
            seen.add(key)
    return gone


@pytest.mark.parametrize("w", [1, 2, 3, 5])
def test_removal_equals_brute_force(spark, w):
    rows = [r for r in random_docs(vocabulary=2) if r[0] is not None] + [(None, "w1 w2 w3\nq\nw0", None, None, 0)]
    rows += [(2000 + i, f"{'a long line ' * 9}{i % 3}\nown {i}", None, None, 0) for i in range(7)]
    rows += [(3000 + i, f"one line {i % 2}", None, None, 0) for i in range(5)] + [(3010, "one line 0\nx", None, None, 0)]
    rows += [(1000 + i, f"own {i}\nhot one\nhot two\n\nhot three", None, None, 0) for i in range(60)]
    gone = slow(rows, w)
    want = []
    for r in rows:
        out = gone.get(r[:2], set())
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in out)
        want.append((r[0], kept, tuple(sorted(out))))
    docs = docs_frame(spark, rows)
    got = line_dedup.remove_repeated_lines(docs, min_lines=w)
    assert set(got.columns) == set(docs.columns)
    assert same_rows([(r["doc_id"], r["text"], tuple(r["removed_lines"])) for r in got.collect()], want)


def test_suffix_array_equals_brute_force(spark):
    rows = [(i, "\n".join("ab"[int(b)] for b in f"{i:b}" * (1 + i % 3)), None, None, 0) for i in range(1, 60)]
    lines = line_dedup.line_table(docs_frame(spark, rows), "doc_id", "text").cache()
    ids = {(r["doc"], r["pos"]): (r["h1"], r["h2"]) for r in lines.collect()}
    length = {}
    for d, p in ids:
        length[d] = max(length.get(d, 0), p + 1)
    suffix = {(d, p): [ids[d, q] for q in range(p, length[d])] for d, p in ids}
    order = sorted(suffix.values())
    got = line_dedup.suffix_ranks(lines).collect()
    assert len(got) == len(ids)
    for r in got:
        own = suffix[r["doc"], r["pos"]]
        assert (r["rank"], r["size"]) == (order.index(own), order.count(own))


@pytest.mark.parametrize("long_line", [1, 10, 10**9])
def test_long_lines_are_runs_of_their_own(spark, long_line):
    rows = random_docs(40, vocabulary=3)
    rows = [r for r in rows if r[0] is not None]
    gone = slow(rows, 2, long_line)
    got = line_dedup.remove_repeated_lines(docs_frame(spark, rows), long_line=long_line).collect()
    want = [(r[0], tuple(sorted(gone.get(r[:2], ())))) for r in rows]
    assert same_rows([(r["doc_id"], tuple(r["removed_lines"])) for r in got], want)


def test_copied_lengths_are_intervals_of_the_suffix_array(spark):
    rows = [(i, "\n".join(["a", "b", "c", "d", "e", "f", "g"][: 2 + i % 6] + [f"own {i}"] * (i % 2)), None, None, 0) for i in range(20)]
    lines = line_dedup.line_table(docs_frame(spark, rows), "doc_id", "text").cache()
    got = {(r["id"], r["pos"]): r for r in line_dedup.suffix_ranks(lines).collect()}
    text = {r[0]: r[1].split("\n") for r in rows}
    for (i, p), r in got.items():
        own = text[i][p:]
        shared = [sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(own, text[j][q:]))) for j, q in got if (j, q) < (i, p)]
        longest = max(shared, default=0)
        whole = any(s == len(own) == len(text[j][q:]) for s, (j, q) in zip(shared, [x for x in got if x < (i, p)]))
        if longest < 2:
            assert r["copied"] == 0
        else:
            # The interval found is the one of the largest power of two, or the whole rest.
            assert longest // 2 < r["copied"] <= longest and (not whole or r["copied"] == len(own))


def test_columns_named_like_helpers_are_kept(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y", "z"), (2, "a\nb", "x", "y", "z")], "doc_id long, text string, own string, `key` string, cut string")
    got = line_dedup.remove_repeated_lines(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in got] == [(1, "a\nb", "x", "y", "z"), (2, "", "x", "y", "z")]


def test_empty_table(spark):
    assert line_dedup.remove_repeated_lines(docs_frame(spark, [])).collect() == []
