"""SimHash near-dedup with a Gray-order hierarchical index.

A document's fingerprint takes the majority of every bit over the XXH64 values of
its word shingles. Fingerprints link at ``max_bits`` or fewer differing bits.

Only distinct fingerprints are compared, and all links between them are found:
the bits are cut into ``max_bits + 2`` segments, so two linked fingerprints agree
in at least two of them. For every choice of two segments the fingerprints that
agree there form a group. A group is sorted by Gray rank and indexed: a node
covers consecutive fingerprints (or nodes) and keeps the bit pattern they share.
Node pairs are walked from the root: the bits in which two shared patterns
differ are a lower bound that grows from level to level and prunes whole nodes;
pairs of nodes that must link as a whole, or already lie in one component, are not
opened either. Each task returns the links of a spanning forest, so thousands of
near copies do not become all their pairs.

Groups above ``group_limit`` fingerprints are not held in a task. They are cut
again, by the same rule, on the bits not yet fixed; every cut fixes more bits and
so bounds the group.

Defined cases: a null or empty text has fingerprint zero, linked like any other;
a text with fewer words than a shingle is one shingle; rows with equal ids are
judged row by row; a component whose ids are all null has a null id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.common import partitions, written
from screenspark.llm.components import stars

SHINGLE, MAX_BITS, SEED = 4, 4, 42
GROUP_LIMIT = 1 << 20
FANOUT = 8
PAIRS_AT_ONCE = 1 << 20
ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    first, last = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(tables):
        for t in tables:
            found = np.array([fingerprint(x, shingle) for x in t["text"].to_pylist()], np.uint64)
            columns = [t["id"], t["row_key"], pa.array(found.view(np.int64))]
            yield pa.record_batch(columns, names=["id", "row_key", "fp"])

    return run


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text; rows that repeat both share it."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, row_key, fp)``; the 64 bits are held in a signed long."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = row_key(id_col, text_col).alias("row_key")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key, text.alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id long, row_key long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of the bit pattern in Gray order, as a signed long with the same order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def segment_masks(fixed: int, max_bits: int) -> list[int]:
    """Masks that add two of ``max_bits + 2`` segments of the bits not yet ``fixed``."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [round(i * len(free) / (max_bits + 2)) for i in range(max_bits + 3)]
    segments = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [fixed | a | b for a, b in combinations(segments, 2)]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of ``a[i]`` and ``b[i]``; a label is the smallest member of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


class Index:
    """Hierarchy over fingerprints that are sorted by group and, inside, by Gray rank."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        ones, group, start = fps, group, np.arange(len(fps))
        self.levels = [(fps, fps, start, np.append(start[1:], len(fps)))]
        zeros = fps
        while True:
            turn = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(group)) - np.repeat(turn, np.diff(np.append(turn, len(group))))
            if not place.any():
                break
            heads = np.flatnonzero(place % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_or.reduceat(zeros, heads)
            # ones: bits that all below have; zeros: bits that any below has; heads: first child.
            self.levels.append((ones, zeros, heads, np.append(heads[1:], len(group))))
            group, start = group[heads], start[heads]

    def members(self, level: int, node: np.ndarray, last: bool) -> np.ndarray:
        """First (or one past the last) fingerprint below each node."""
        node = node + 1 if last else node
        for at in range(level, 0, -1):
            heads = self.levels[at][2]
            node = np.append(heads, len(self.levels[at - 1][0]))[node]
        return node

    def links(self, label: np.ndarray, max_bits: int) -> np.ndarray:
        """Component label of every fingerprint."""
        top = len(self.levels) - 1
        root = np.arange(len(self.levels[top][0]))
        work = [(top, root, root)]
        while work:
            level, a, b = work.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                work += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            ones, any_ = self.levels[level][:2]
            least = np.bitwise_count((ones[a] & ~any_[b]) | (ones[b] & ~any_[a]))
            most = np.bitwise_count((any_[a] | any_[b]) & ~(ones[a] & ones[b]))
            if level == 0:
                near = (a != b) & (least <= max_bits)
                label = merge(label, a[near], b[near])
                continue
            at = self.members(level, np.arange(len(ones)), False)
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            known = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            whole = (most <= max_bits) & ~known
            for x, y in zip(a[whole], b[whole]):
                spans = [np.arange(*(int(self.members(level, np.array([n]), e)[0]) for e in (False, True))) for n in (x, y)]
                every = np.concatenate(spans)
                label = merge(label, every, np.full(len(every), every[0]))
            a, b = (v[(least <= max_bits) & ~whole & ~known] for v in (a, b))
            heads, ends = self.levels[level][2:]
            wide = (ends[b] - heads[b]).astype(np.int64)
            pairs = (ends[a] - heads[a]) * wide
            which = np.repeat(np.arange(len(a)), pairs)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x, y = heads[a][which] + nth // wide[which], heads[b][which] + nth % wide[which]
            opened = x <= y  # a node with itself: each pair of children once
            if opened.any():
                work.append((level - 1, x[opened], y[opened]))
        return label


def _forest(masks: np.ndarray, keys: np.ndarray, fps: np.ndarray, max_bits: int):
    """Links of a spanning forest of each group."""
    fresh = np.concatenate(([True], (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])))
    group = np.cumsum(fresh)
    size = np.diff(np.append(np.flatnonzero(fresh), len(fps)))
    more = np.repeat(size > 1, size)
    fps, group = fps[more], group[more]
    if not len(fps):
        return fps, fps
    label = np.arange(len(fps))
    next_ = np.arange(len(fps) - 1)
    near = (group[1:] == group[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= max_bits)
    label = merge(label, next_[near], next_[near] + 1)
    label = Index(fps, group).links(label, max_bits)
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _linked(max_bits: int, limit: int):
    def link(tables: Iterator):
        """Rows ``(mask, a, b)``: links with a null mask, or members of a too large group with their mask."""
        held = [np.zeros(0, np.int64)] * 3
        skipping = None
        for table in tables:
            new = [table[c].to_numpy() for c in ("mask", "key", "fp")]
            held = [np.concatenate(p) for p in zip(held, new)]
            if not len(held[0]):
                continue
            last = (held[0][-1], held[1][-1])
            tail = int(np.argmax((held[0] == last[0]) & (held[1] == last[1])))
            ready, held = [h[:tail] for h in held], [h[tail:] for h in held]
            if skipping is not None and len(ready[0]):  # the rest of a group that is passed on
                same = (ready[0] == skipping[0]) & (ready[1] == skipping[1])
                yield _passed(*(r[same] for r in ready))
                ready = [r[~same] for r in ready]
                skipping = None
            if len(ready[0]):
                yield _found(*_forest(ready[0], ready[1], ready[2].view(np.uint64), max_bits))
            if len(held[0]) > limit or skipping == last:
                yield _passed(*held)
                held, skipping = [h[:0] for h in held], last
        if len(held[0]):
            if skipping is not None and skipping == (held[0][0], held[1][0]):
                yield _passed(*held)
            else:
                yield _found(*_forest(held[0], held[1], held[2].view(np.uint64), max_bits))

    return link


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    signed = [pa.array(x.view(np.int64)) for x in (a, b)]
    return pa.record_batch([pa.nulls(len(a), pa.int64()), *signed], ["mask", "a", "b"])


def _passed(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(mask), pa.array(fp), pa.array(fp)], ["mask", "a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(a, b)``: links that span every component of the distinct fingerprints in ``fp``."""
    spark, links = fps.sparkSession, None
    jobs = fps.select(F.explode(F.lit([_signed(m) for m in segment_masks(0, max_bits)])).alias("mask"), "fp")
    while True:
        keyed = jobs.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).withColumn("rank", gray_rank(F.col("fp")))
        sorted_ = keyed.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "rank")
        out = written(
            sorted_.select("mask", "key", "fp").mapInArrow(_linked(max_bits, group_limit), "mask long, a long, b long")
        )
        found = out.filter("mask is null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        left = [r["mask"] for r in out.filter("mask is not null").select("mask").distinct().collect()]
        finer = {m: [_signed(x) for x in segment_masks(m & ALL, max_bits)] for m in left}
        if not finer:
            return links
        table = spark.createDataFrame([(m, f) for m, fs in finer.items() for f in fs], "old long, mask long")
        passed = out.filter("mask is not null").select(F.col("mask").alias("old"), F.col("a").alias("fp"))
        jobs = passed.join(F.broadcast(table), "old").select("mask", "fp")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per input row.

    ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable), ``class_fp`` (one fingerprint of the component) and ``row_key``.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    root = stars(near_links(nodes.select("fp"), max_bits, group_limit))
    placed = nodes.join(root, F.col("fp") == F.col("a"), "left")
    # Written on both sides: the join can then split a large component.
    placed = written(placed.select("fp", "least", F.coalesce("b", "fp").alias("class_fp")))
    heads = written(placed.groupBy("class_fp").agg(F.min("least").alias("component_id")))
    named = written(placed.join(heads, "class_fp").select(F.col("fp").alias("node"), "component_id", "class_fp"))
    return rows.join(named, F.col("fp") == F.col("node")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "class_fp",
        "row_key",
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (by hash of its text, if rows repeat the id)."""
    groups = near_groups(docs, id_col, text_col, **options)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("class_fp")
    keep = written(first.agg(F.min("row_key").alias("__keep")).select("__keep").distinct())
    keyed = docs.withColumn("__key", row_key(id_col, text_col)).join(keep, F.col("__key") == F.col("__keep"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return keyed.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
