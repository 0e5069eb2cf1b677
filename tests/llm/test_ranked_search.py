import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from screenspark.llm import ranked_search
from tests.llm.helpers import docs_frame, random_docs, same_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EXTRA = "item_id long, text string, terms string, place string, score string"


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, top=10):
    bags = [(doc_id, Counter(cut(text))) for doc_id, text in docs]
    bags = [(i, b) for i, b in bags if b]
    all_docs, all_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, bag in bags:
            m = 100 - 90 + (90 * bag.total() * all_docs) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in terms
                if t in bag
            )
            scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored = sorted(s for s in scored if s[0] < 0)[:top]
        out += [(item, n, s[3], -s[0]) for n, s in enumerate(scored, 1)]
    return out


def found(spark, rows, items, **options):
    frame = spark.createDataFrame([(*i, "x", "y", "z") for i in items], EXTRA)
    got = ranked_search.search(ranked_search.build_index(docs_frame(spark, rows)), frame, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    return list(map(tuple, got.collect()))


def shaped(n=400, seed=5):
    """Texts over a skewed vocabulary, and items of such words."""
    pick = random.Random(seed)
    names = [f"t{i}" for i in range(300)]
    shares = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(pick.choices(names, shares, k=pick.randint(5, 80))), "en", "s", 0) for i in range(n)]
    items = [(i, " ".join(pick.choices(names, shares, k=pick.randint(1, 25)))) for i in range(30)]
    return rows, items


ITEMS = [(1, "w1 W2, w3!"), (2, None), (3, "nothing here"), (4, "É ab AÉ"), (5, "w1"), (5, "w5 w6"), (5, "w1"), (None, "w7 w8"), (6, "w0 " * 5000)]


@pytest.mark.parametrize("block_bytes", [4 << 20, 400])
def test_equals_brute_force_with_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ranked_search.row_blocks, "__defaults__", (block_bytes,))
    rows = random_docs(150)
    want = brute_force([r[:2] for r in rows], ITEMS)
    assert same_rows(found(spark, rows, ITEMS), want)


def test_pairs_and_blocks_of_items_change_nothing(spark, monkeypatch):
    rows, items = shaped()
    want = brute_force([r[:2] for r in rows], items)
    assert same_rows(found(spark, rows, items), want)
    assert same_rows(found(spark, rows, items, with_pairs=False), want)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    assert same_rows(found(spark, rows, items), want)
    assert same_rows(found(spark, rows, items, top=3), [r for r in want if r[1] <= 3])


def test_empty_tables(spark):
    rows, items = shaped(5)
    assert found(spark, [], items) == []
    assert found(spark, rows, []) == []
    assert found(spark, [(1, None, None, None, None)], [(1, "a")]) == []


def test_sql_equals_brute_force():
    rows, items = random_docs(80), [(1, "w1 W2, w3!"), (2, None), (4, "É ab AÉ"), (5, "w1"), (5, "w5 w6")]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
        db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        got = db.execute(ranked_search.SQL).fetchall()
    assert same_rows(got, brute_force([r[:2] for r in rows], items))


def test_pair_bounds_hold_and_are_never_looser():
    pick = np.random.default_rng(3)
    for _ in range(200):
        n = int(pick.integers(1, 9))
        table = pick.integers(1, 100, (n, 40)) * (pick.random((n, 40)) < 0.4)
        lists = [(np.flatnonzero(t), t[t > 0]) for t in table]
        joint = np.array([ranked_search.joint_maximum(*lists[i], *lists[i + 1]) for i in range(0, n - 1, 2)], np.int64)
        highest = table.max(axis=1)
        alone, paired = ranked_search.score_bounds(highest, joint[:0]), ranked_search.score_bounds(highest, joint)
        exact = np.concatenate(([0], table.cumsum(axis=0).max(axis=1)))
        assert (exact <= paired).all() and (paired <= alone).all() and (np.diff(paired) >= 0).all()


def entries_read(spark, rows, items, with_pairs):
    """List entries that the items read in all shards when the results needed are known from the start."""
    index = ranked_search.build_index(docs_frame(spark, rows))
    (block,) = ranked_search._blocks(ranked_search.item_terms(spark.createDataFrame(items, "item_id long, text string")))
    block = ranked_search._weighted(block, index, with_pairs)
    impacts = ranked_search._impact_table(index, block)
    for r in ranked_search._best(impacts, block, 10).filter("rank = 10").collect():
        block.need[r["item"]] = r["score"]
    read = 0
    for row in impacts.toArrow().to_pylist():
        shard = ranked_search.Shard(row, len(block.hashes))
        for i, terms in enumerate(block.items):
            read += ranked_search.search_shard(shard, terms, block.item_pairs[i], int(block.need[i]))[2]
    every = sum(len(ranked_search.Shard(r, len(block.hashes)).list_of(t)[0]) for r in impacts.toArrow().to_pylist() for x in block.items for t in x)
    return read, every


def test_pairs_skip_more_than_single_maxima(spark, monkeypatch):
    monkeypatch.setattr(ranked_search.row_blocks, "__defaults__", (4000,))
    rows, items = shaped()
    paired, every = entries_read(spark, rows, items, True)
    single, _ = entries_read(spark, rows, items, False)
    assert paired < single < every
