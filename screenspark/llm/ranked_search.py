r"""Ranked lexical search: MaxScore with joint maximum impacts of term pairs.

Index: every task turns its documents into shards of some 4 MB of text, each an
inverted index of its own: sorted term hashes, and per term the documents and how often
they hold it. No text is shuffled. The impact of a term in a document is ``w * s``:
``w`` falls with the number of documents that hold the term, ``s`` grows with its
occurrences and falls with the length of the document; both need totals of the whole
table, which every shard adds to.

Queries come in blocks of at most ``BLOCK_ITEMS`` items and some ``BLOCK_TERMS`` terms. For a block every shard
stores the impact lists of the block's terms, each term's maximum, and, for pairs of
terms that meet in an item, the maximum of the two impacts' sum over the intersection
of their lists. An item's terms are paired by ascending weight, neighbour with neighbour.

Search, shard by shard and item by item: an item's ``n`` terms ascend by weight;
``bounds[k]`` limits the score of a document that holds only the first ``k``. A pair
counts with its joint maximum (or the larger single one), which is at most the sum of
the two. Terms whose bound stays below the score that a result needs only complete
documents found through the others, and only those that can still reach it; shards
whose whole bound stays below are skipped. What a result needs is the tenth best
score so far in this task or, from the start, that of a few shards searched before. All bounds are
exact, so results equal the full evaluation.

Defined cases: a null or empty text has no term and is neither found nor counted; rows
that repeat an id are documents of their own; a null id ranks behind equal scores; rows
of one item id are one item with the terms of all of them, a null item id too; an item
without a known term has no result; empty tables give an empty result; other columns
are ignored, whatever their names. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.byte_words import row_blocks, words
from screenspark.llm.common import LARGEST_ID, pack, pack_sorted, unpack, unpack_sorted, word_hashes, written

TOP = 10
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
FIRST_SHARDS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# ---- index ----------------------------------------------------------------------------------

SHARD = pa.schema(
    [
        ("place", pa.int64()),  # decides which shards are searched first
        ("n_docs", pa.int64()),
        ("n_terms", pa.int64()),
        ("ids", pa.binary()),
        ("nulls", pa.binary()),
        ("lengths", pa.binary()),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
        ("docs", pa.binary()),
        ("tfs", pa.binary()),
    ]
)


def _shard(block: pa.RecordBatch) -> tuple | None:
    each = [words(t) for t in block["text"].to_pylist()]
    full = [i for i, w in enumerate(each) if w]
    if not full:
        return None
    found = block["doc_id"].take(pa.array(full))
    ids = found.fill_null(LARGEST_ID).to_numpy(zero_copy_only=False)
    nulls = found.is_null().to_numpy(zero_copy_only=False)
    lengths = np.array([len(each[i]) for i in full], np.int64)
    owner = np.repeat(np.arange(len(full), dtype=np.uint32), lengths)
    hashes = word_hashes([w for i in full for w in each[i]])
    order = np.argsort(hashes, kind="stable")  # documents of a term stay in order
    hashes, owner = hashes[order], owner[order]
    new_term = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    begins = np.flatnonzero(new_term | np.concatenate(([True], owner[1:] != owner[:-1])))
    tfs = np.diff(np.append(begins, len(hashes))).astype(np.uint32)
    firsts = np.flatnonzero(new_term[begins])
    counts = np.diff(np.append(firsts, len(begins))).astype(np.uint32)
    place = int(word_hashes([ids.tobytes()])[0] >> np.uint64(1))
    columns = (pack(ids), pack(np.packbits(nulls)), pack(lengths), pack_sorted(hashes[begins][firsts]), pack(counts))
    return place, len(full), int(lengths.sum()), *columns, pack(owner[begins]), pack(tfs)


def _shards(tables):
    for block in row_blocks(tables, "text"):
        row = _shard(block)
        if row:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, SHARD)], schema=SHARD)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents, as a written table."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    schema = "place long, n_docs long, n_terms long, ids binary, nulls binary, lengths binary, terms binary, counts binary, docs binary, tfs binary"
    return written(rows.mapInArrow(_shards, schema))


# ---- queries --------------------------------------------------------------------------------


def _hashed(tables):
    for block in row_blocks(tables, "text"):
        found = [np.unique(word_hashes(words(t))).view(np.int64) for t in block["text"].to_pylist()]
        yield pa.record_batch([block["item_id"], pa.array(found, pa.list_(pa.int64()))], names=["item_id", "terms"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms``: the distinct term hashes of every item that has one."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text)
    each = rows.mapInArrow(_hashed, "item_id long, terms array<long>").select("item_id", F.explode("terms").alias("term")).distinct()
    return each.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


@dataclass
class Block:
    """Some items, their terms by number, and what the whole index says about the terms."""

    ids: list[int | None]
    hashes: np.ndarray  # ascending, of all items
    items: list[np.ndarray]  # term numbers; ascending by weight once that is known
    weights: np.ndarray | None = None
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # distinct pairs of term numbers
    item_pairs: list[np.ndarray] = field(default_factory=list)
    need: np.ndarray | None = None  # score that a result of each item needs
    n_docs: int = 0
    n_terms: int = 0


def _blocks(items: DataFrame) -> Iterator[Block]:
    ids: list[int | None] = []
    terms: list[np.ndarray] = []

    def block() -> Block:
        hashes = np.unique(np.concatenate(terms))
        return Block(list(ids), hashes, [np.searchsorted(hashes, t) for t in terms])

    for row in items.toLocalIterator():  # one task's items at a time
        ids.append(row["item_id"])
        terms.append(np.array(row["terms"], np.int64).view(np.uint64))
        if len(ids) >= BLOCK_ITEMS or sum(map(len, terms)) >= BLOCK_TERMS:
            yield block()
            ids, terms = [], []
    if ids:
        yield block()


def _frequencies(index: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """How many documents hold each term of a block."""
    wanted = index.sparkSession.sparkContext.broadcast(hashes)

    def count(tables):
        total = np.zeros(len(wanted.value), np.int64)
        for table in tables:
            for terms, counts in zip(table["terms"].to_pylist(), table["counts"].to_pylist()):
                _, at, here = np.intersect1d(wanted.value, unpack_sorted(terms), assume_unique=True, return_indices=True)
                total[at] += unpack(counts, np.uint32)[here]
        known = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(known, pa.int64()), "n": pa.array(total[known], pa.int64())})

    out = np.zeros(len(hashes), np.int64)
    for row in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def _weighted(block: Block, index: DataFrame, with_pairs: bool) -> Block:
    """The block with term weights, its items' known terms by ascending weight, and their pairs."""
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    block.n_docs, block.n_terms = map(int, totals)
    df = _frequencies(index, block.hashes)
    top = float(2 * block.n_docs + 2)
    block.weights = np.array([math.floor(1000 * math.log(top / float(2 * n + 1))) for n in df.tolist()], np.int64)
    block.items = [known[np.lexsort((known, block.weights[known]))] for t in block.items for known in [t[df[t] > 0]]]
    block.need = np.ones(len(block.ids), np.int64)
    number: dict[tuple[int, int], int] = {}
    for terms in block.items:
        met = zip(terms[0::2].tolist(), terms[1::2].tolist()) if with_pairs else ()
        block.item_pairs.append(np.array([number.setdefault(p, len(number)) for p in met], np.int64))
    block.pairs = np.array(list(number), np.int64).reshape(-1, 2)
    return block


# ---- impacts --------------------------------------------------------------------------------

IMPACTS = pa.schema(
    [
        ("place", pa.int64()),
        ("ids", pa.binary()),
        ("nulls", pa.binary()),
        ("n_docs", pa.int64()),
        ("present", pa.binary()),  # numbers of the block's terms that the shard holds
        ("counts", pa.binary()),
        ("docs", pa.binary()),
        ("impacts", pa.binary()),
        ("joint", pa.binary()),  # of every pair of the block; 0 where the two never meet
    ]
)


def joint_maximum(docs_a: np.ndarray, impacts_a: np.ndarray, docs_b: np.ndarray, impacts_b: np.ndarray) -> int:
    """The largest sum of two terms' impacts over the documents that hold both; 0 if there is none."""
    if len(docs_a) > len(docs_b):
        docs_a, impacts_a, docs_b, impacts_b = docs_b, impacts_b, docs_a, impacts_a
    at = np.searchsorted(docs_b, docs_a)
    at[at == len(docs_b)] = 0
    both = docs_b[at] == docs_a
    return int((impacts_a[both] + impacts_b[at[both]]).max()) if both.any() else 0


def _impacts(row: dict, block: Block) -> tuple | None:
    _, present, here = np.intersect1d(block.hashes, unpack_sorted(row["terms"]), assume_unique=True, return_indices=True)
    if not len(present):
        return None
    counts = unpack(row["counts"], np.uint32).astype(np.int64)
    begins = np.cumsum(counts) - counts
    sizes = counts[here]
    at = np.repeat(begins[here] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    docs = unpack(row["docs"], np.uint32)[at]
    tf = unpack(row["tfs"], np.uint32)[at].astype(np.int64)
    m = 100 - 90 + (90 * unpack(row["lengths"], np.int64) * block.n_docs) // block.n_terms
    impacts = np.repeat(block.weights[present], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
    ends = np.cumsum(sizes)
    lists = {t: slice(e - n, e) for t, e, n in zip(present.tolist(), ends.tolist(), sizes.tolist())}
    joint = np.zeros(len(block.pairs), np.int64)
    for i, (a, b) in enumerate(block.pairs.tolist()):
        if a in lists and b in lists:
            joint[i] = joint_maximum(docs[lists[a]], impacts[lists[a]], docs[lists[b]], impacts[lists[b]])
    packed = [pack(x) for x in (present.astype(np.uint32), sizes.astype(np.uint32), docs, impacts, joint)]
    return row["place"], row["ids"], row["nulls"], row["n_docs"], *packed


def _impact_table(index: DataFrame, block: Block) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)

    def rows(tables):
        for table in tables:
            for i in range(table.num_rows):
                found = _impacts(table.slice(i, 1).to_pylist()[0], shared.value)
                if found:
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(found, IMPACTS)], schema=IMPACTS)

    schema = "place long, ids binary, nulls binary, n_docs long, present binary, counts binary, docs binary, impacts binary, joint binary"
    return written(index.mapInArrow(rows, schema))


# ---- search ---------------------------------------------------------------------------------


class Shard:
    """The impact lists of one shard, by term number of the block."""

    def __init__(self, row: dict, n_terms: int):
        self.ids, self.n_docs = unpack(row["ids"], np.int64), row["n_docs"]
        self.nulls = np.unpackbits(unpack(row["nulls"], np.uint8), count=self.n_docs).astype(bool)
        present, sizes = unpack(row["present"], np.uint32), unpack(row["counts"], np.uint32).astype(np.int64)
        self.docs, self.impacts = unpack(row["docs"], np.uint32), unpack(row["impacts"], np.int64)
        self.begins, self.ends = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.ends[present] = np.cumsum(sizes)
        self.begins[present] = self.ends[present] - sizes
        self.highest = np.zeros(n_terms, np.int64)
        self.highest[present] = np.maximum.reduceat(self.impacts, self.begins[present])
        self.joint = unpack(row["joint"], np.int64) if row["joint"] else np.zeros(0, np.int64)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begins[term], self.ends[term])
        return self.docs[part], self.impacts[part]


def score_bounds(highest: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """``bounds[k]``: no document that holds only the first ``k`` terms scores more.

    ``highest`` are the terms' maximum impacts; ``joint`` the joint maxima of the
    first and second term, the third and fourth, and so on, or nothing.
    """
    if not len(joint):
        return np.concatenate(([0], np.cumsum(highest)))
    bounds = np.zeros(len(highest) + 1, np.int64)
    n = 2 * len(joint)
    pairs = np.maximum(np.maximum(highest[0:n:2], highest[1:n:2]), joint)
    bounds[2 : n + 1 : 2] = np.cumsum(pairs)
    bounds[1::2] = bounds[0:-1:2] + highest[0::2]
    return bounds


def search_shard(shard: Shard, terms: np.ndarray, pairs: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of the shard that score ``need`` or more, their scores, and how many list entries were read."""
    highest = shard.highest[terms]
    bounds = score_bounds(highest, shard.joint[pairs])
    nothing = np.zeros(0, np.int64)
    if bounds[-1] < need:
        return nothing, nothing, 0
    split = int(np.searchsorted(np.maximum.accumulate(bounds), need)) - 1  # documents with these terms only fall short
    total, read = np.zeros(shard.n_docs, np.int64), 0
    for term in terms[split:]:
        docs, impacts = shard.list_of(term)
        total[docs] += impacts
        read += len(docs)
    found = np.flatnonzero((total > 0) & (total + bounds[split] >= need))
    for k in range(split - 1, -1, -1):
        docs, impacts = shard.list_of(terms[k])
        if len(docs) and len(found):
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            total[found] += np.where(docs[at] == found, impacts[at], 0)
            read += len(found)
        found = found[total[found] + bounds[k] >= need]
    return found, total[found], read


def _searched(shared, top: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(tables):
        block, best = shared.value, {}
        need = block.need.copy()
        for table in tables:
            for i in range(table.num_rows):
                shard = Shard(table.slice(i, 1).to_pylist()[0], len(block.hashes))
                for item, terms in enumerate(block.items):
                    found, scores, _ = search_shard(shard, terms, block.item_pairs[item], int(need[item]))
                    if not len(found):
                        continue
                    rows = (scores, shard.nulls[found], shard.ids[found])
                    if item in best:
                        rows = tuple(np.concatenate(x) for x in zip(best[item], rows))
                    order = np.lexsort((rows[2], rows[1], -rows[0]))[:top]
                    best[item] = tuple(x[order] for x in rows)
                    if len(order) == top:
                        need[item] = max(need[item], best[item][0][-1])
        for item, (scores, nulls, ids) in best.items():
            n = len(scores)
            yield pa.record_batch([pa.array([item] * n, pa.int32()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())], schema=schema)

    return search


def _best(impacts: DataFrame, block: Block, top: int) -> DataFrame:
    """``item, doc_id, score, rank``: every task's best of every item, then the best of these."""
    shared = impacts.sparkSession.sparkContext.broadcast(block)
    found = impacts.mapInArrow(_searched(shared, top), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, with_pairs: bool = True) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item in the table that ``build_index`` made."""
    spark, parts = index.sparkSession, []
    n_shards = index.count()
    for block in _blocks(item_terms(items, id_col, text_col)):
        block = _weighted(block, index, with_pairs)
        impacts = _impact_table(index, block)
        first = impacts.filter(F.col("place") % max(1, n_shards // FIRST_SHARDS) == 0)
        for row in _best(first, block, top).filter(F.col("rank") == top).collect():  # one row per item of the block
            block.need[row["item"]] = row["score"]
        names = spark.createDataFrame(list(enumerate(block.ids)), "number int, item_id long")
        found = _best(impacts, block, top).join(F.broadcast(names), F.col("item") == F.col("number"))
        parts.append(written(found.select("item_id", "rank", "doc_id", "score")))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents),
n AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM n),
t AS (SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY row_no, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark)),
s AS (
  SELECT q.item_id, n.row_no, n.doc_id,
         sum(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN n USING (row_no), c GROUP BY q.item_id, n.row_no, n.doc_id),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}"""
