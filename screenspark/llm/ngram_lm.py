"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training texts are quantised to levels of their
logarithm. A gram of level q is entered into a Bloom filter q times, as (gram, 1)
to (gram, q); a lookup probes level after level until one is missing and so reads
the level back, never too low. A level stands for the mean count of its grams in the
corpus. The filter has ``BITS_PER_EVENT`` bits for every event of every word and pair,
so it grows with the corpus. It is a table of shards, one for each bucket of leading
hash bits and gram size; neither the driver nor a worker holds it whole. This departs
from a broadcast filter, which would need a bound: chunks of documents send the shards
their distinct words and pairs and get levels back, and for words the exact counts that
the base score needs.

Counting: every batch of documents sends its distinct grams with their counts to
the bucket of their leading hash bits, where they are summed and entered.

Model, with c the counts read back from the filter, N tokens, V distinct tokens::

    P(w)   = (c(w) + 1) / (N + V + 1)
    P(w|u) = (b(u w) c(u w) + t(u) P(w)) / (c(u) + t(u)),   t(u) = c(u) ** growth

t(u) models the number of distinct words that follow u as a power of its count, at
which these add up to the number of distinct pairs in the corpus. The filter answers
yes for a share f of the pairs that it does not hold, f V words for every u, which would
make P(.|u) add up to far more than 1 after a rare u. So a pair of the lowest level, the
only one at which such answers matter, counts with the chance that it is a true one::

    b(u w) = t1(u) / (t1(u) + f V),   t1(u) = c(u) ** growth1

where t1 models the followers seen once in the same way and f comes from the bits that
are set. P(w) adds up to 1 over all words and one unknown one, P(w|u) nearly
(tested to a tenth). c(u w) never exceeds c(u) or c(w). The score of a text is the sum of
log10 P(w|u) over its words and the end token; the first word follows an end token.

Defined cases: a null or empty text is one end token; a null id is a training
row; an empty table gives an empty result; without training rows every count is
0. Words are told apart by 64-bit hashes, pairs by 48 bits. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import (
    bucket_cuts,
    chunk_plan,
    document_chunks,
    mixed,
    pack,
    pack_sorted,
    remainder,
    unpack,
    unpack_sorted,
    word_hashes,
    written,
)

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end token
PAIR = np.uint64(0x9E3779B97F4A7C15)
LEVEL_BASE = 1.25
# An event sets four bits in each of four words of 64 bits: 16 probes, four of which take one look.
BITS_PER_EVENT, WORDS = 26, 4
LEVELS = 128
PAIR_BITS = np.uint64(0xFFFFFFFFFFFF0000)  # a pair's leading 48 bits: they travel at two thirds of the size
BATCH_BYTES = 8 << 20


TWO_BITS = (np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63))) | (
    np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6))
)


class Tokens:
    """Token hashes of some texts, one after the other, each with its end token."""

    def __init__(self, texts: list[bytes]):
        words = [t.lower().split() for t in texts]  # bytes.lower() changes A-Z only
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.grams = np.full(int(self.lengths.sum()), END, np.uint64)
        inner = np.ones(len(self.grams), bool)
        inner[self.ends - 1] = False
        self.grams[inner] = word_hashes(list(itertools.chain.from_iterable(words)))
        self.before = np.roll(self.grams, 1)  # every text follows an end token
        self.before[:1] = END
        self.pairs = mixed(self.before * PAIR + self.grams) & PAIR_BITS

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ends - self.lengths)


def _batches(tables, column: str):
    texts, size = [], 0
    for batch in tables:
        for text in batch[column].to_pylist():
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _counted(bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.int8()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def count(tables):
        for texts in _batches(tables, "text"):
            tokens, out = Tokens(texts), []
            for size, grams in ((1, tokens.grams), (2, tokens.pairs)):
                hashes, counts = np.unique(grams, return_counts=True)
                cuts = bucket_cuts(hashes, bits)
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    out.append((int(b), size, pack_sorted(hashes[part]), pack(counts[part])))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return count


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)), the quantised count."""
    return (np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9) + 1).astype(np.int64)


SHARD = pa.schema(
    [
        ("bucket", pa.int32()),
        ("size", pa.int8()),
        ("tokens", pa.int64()),
        ("grams", pa.list_(pa.int64())),  # by level
        ("mass", pa.list_(pa.int64())),  # their counts
        ("false_events", pa.float64()),  # chance of a false yes, for each word of the filter
        ("bits", pa.binary()),
        ("hashes", pa.binary()),  # of words, with their exact counts
        ("counts", pa.binary()),
    ]
)
SHARD_KINDS = "bucket int, size byte, tokens long, grams array<long>, mass array<long>, false_events double, bits binary, hashes binary, counts binary"


def _shard(table: pa.Table) -> pa.Table:
    """The summed counts of one bucket and gram size, entered into their filter."""
    hashes = np.concatenate([unpack_sorted(b) for b in table["hashes"].to_pylist()])
    counts = np.concatenate([unpack(b, np.int64) for b in table["counts"].to_pylist()])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    total = np.add.reduceat(counts[order], first)
    bits, levels, size = filled(ranked[first], total), level(total), table["size"][0].as_py()
    exact = (pack_sorted(ranked[first]), pack(total)) if size == 1 else (None, None)
    row = (
        table["bucket"][0].as_py(),
        size,
        int(total.sum()),
        np.bincount(levels, minlength=LEVELS).tolist(),
        np.bincount(levels, total, LEVELS).astype(np.int64).tolist(),
        false_rate(bits) * len(bits),
        bits.tobytes(),
        *exact,
    )
    return pa.table([pa.array([x], f.type) for x, f in zip(row, SHARD)], SHARD)


def filter_shards(texts: DataFrame, bits: int) -> DataFrame:
    """The filter of all words and pairs as a written table: a shard per bucket and gram size, as large as its events need."""
    counted = texts.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(
        _counted(bits), "bucket int, size byte, hashes binary, counts binary"
    )
    return written(counted.groupBy("bucket", "size").applyInArrow(_shard, SHARD_KINDS))


def _drawn_words(hashes: np.ndarray, levels: np.ndarray, n_words: int):
    """For each of the ``WORDS`` words of every event: its number, and the bits that the event has there."""
    drawn = mixed(hashes + levels.astype(np.uint64) * PAIR)
    other = drawn * PAIR
    at, step = drawn >> np.uint64(32), (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(WORDS):
        spread = (at + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)
        bits = other >> np.uint64(8 + 16 * (i % 2)) if i < 2 else (other * END) >> np.uint64(8 + 16 * (i % 2))
        yield (spread * np.uint64(n_words)) >> np.uint64(32), TWO_BITS[bits & np.uint64(4095)] | TWO_BITS[(bits >> np.uint64(12)) & np.uint64(4095)]


def filled(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter of some grams: an event for every level up to that of the count."""
    top = level(counts)
    events = np.repeat(hashes, top)
    at = np.arange(len(events)) - np.repeat(np.cumsum(top) - top, top) + 1
    words = np.zeros(max(1, -(-len(events) * BITS_PER_EVENT // 64)), np.uint64)
    for word, bits in _drawn_words(events, at, len(words)):
        np.bitwise_or.at(words, word, bits)
    return words


def read_levels(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Level of every gram: probes until one event is missing."""
    levels = np.zeros(len(hashes), np.int64)
    alive, at = np.arange(len(hashes)), 1
    while len(alive):
        hit = np.ones(len(alive), bool)
        for word, bits in _drawn_words(hashes[alive], np.full(len(alive), at), len(words)):
            hit &= words[word] & bits == bits
        alive = alive[hit]
        levels[alive] = at
        at += 1
    return levels


def false_rate(words: np.ndarray) -> float:
    """The chance that a filter answers yes for an event that it does not hold, from the bits that are set in its words."""
    share = np.bitwise_count(words) / 64.0
    return float((share**4).mean() ** WORDS)


class Model:
    """What the workers know of the whole corpus: totals, powers, the filter's errors, and the mean count of every level."""

    def __init__(self, grams: dict[int, np.ndarray], mass: dict[int, np.ndarray], false_rate: float):
        self.mean = {size: np.where(grams[size] > 0, mass[size] / np.maximum(1, grams[size]), 0.0) for size in (1, 2)}
        self.n, self.v = int(mass[1].sum()), int(grams[1].sum())
        self.false_followers = false_rate * self.v
        self.growth = _growth(grams[1], self.mean[1], int(grams[2].sum()))
        self.growth1 = _growth(grams[1], self.mean[1], int(grams[2][1]))

    def log10(self, seen: np.ndarray, before: np.ndarray, both: np.ndarray) -> np.ndarray:
        """From the levels read for every word, the word before it and the pair of both."""
        word, context = self.mean[1][seen], self.mean[1][before]
        pair = np.minimum(np.minimum(self.mean[2][both], context), word)
        once = context**self.growth1
        pair = np.where(both == 1, pair * once / np.maximum(once + self.false_followers, 1e-300), pair)
        alone = (word + 1) / (self.n + self.v + 1)
        types = context**self.growth
        known = context > 0
        mix = (pair + types * alone) / np.where(known, context + types, 1.0)
        return np.log10(np.where(known, mix, alone))


def _growth(grams: np.ndarray, mean: np.ndarray, followers: int) -> float:
    """The power of a word's count that sums to the number of distinct followers of all words."""
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if float((grams * np.where(mean > 0, mean, 1.0) ** mid).sum()) < followers else (low, mid)
    return high


def model(shards: DataFrame) -> Model:
    """Only sums and histograms of levels reach the driver."""
    rows = shards.select("size", F.posexplode(F.arrays_zip("grams", "mass")).alias("level", "x"))
    grams, mass = ({1: np.zeros(LEVELS, np.int64), 2: np.zeros(LEVELS, np.int64)} for _ in range(2))
    for r in rows.groupBy("size", "level").agg(F.sum("x.grams").alias("grams"), F.sum("x.mass").alias("mass")).collect():
        grams[r["size"]][r["level"]], mass[r["size"]][r["level"]] = r["grams"], r["mass"]
    pairs = shards.filter("size = 2").agg(F.sum("false_events"), F.sum(F.length("bits") / 8)).first()
    return Model(grams, mass, pairs[0] / pairs[1] if pairs[1] else 0.0)


def _asked(bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        tokens, out = Tokens(table["text"].to_pylist()), []
        sizes = [(h, bucket_cuts(h, bits)) for h in (np.unique(tokens.grams), np.unique(tokens.pairs))]
        for b in np.flatnonzero(sum(np.diff(cuts) for _, cuts in sizes)):
            out.append((int(b), key[0].as_py(), *(pack_sorted(h[cuts[b] : cuts[b + 1]]) for h, cuts in sizes)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema)

    return ask


def _answer(asked: pa.Table, shards: pa.Table) -> pa.Table:
    """Levels of the grams asked for, and exact counts of words."""
    by_size = {r["size"]: r for r in shards.to_pylist()}
    filters = [np.frombuffer(by_size[size]["bits"], np.uint64) if size in by_size else np.zeros(1, np.uint64) for size in (1, 2)]
    known = unpack_sorted(by_size[1]["hashes"]) if 1 in by_size else np.zeros(0, np.uint64)
    number = np.append(unpack(by_size[1]["counts"], np.int64) if 1 in by_size else np.zeros(0, np.int64), 0)
    words, pairs = ([unpack_sorted(x) for x in asked[c].to_pylist()] for c in ("words", "pairs"))

    def answered(queries: list[np.ndarray], found) -> list[bytes]:
        """``found`` for the different grams of all chunks at once, dealt out to the chunks."""
        if not queries:
            return []
        different, which = np.unique(np.concatenate(queries), return_inverse=True)
        parts = np.split(found(different)[which], np.cumsum([len(q) for q in queries])[:-1])
        return [pack(x) for x in parts]

    def exact(hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, hashes)
        same = np.zeros(len(at), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == hashes
        return np.where(same, number[at], 0)

    seen, both = (
        answered(q, lambda hashes, f=f: read_levels(f, hashes).astype(np.int8)) for q, f in zip((words, pairs), filters)
    )
    columns = (pa.array(c, pa.binary()) for c in (answered(words, exact), seen, both))
    return pa.table(dict(zip(("chunk", "bucket", "known", "words", "pairs"), (asked["chunk"], asked["bucket"], *columns))))


SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def _scored(model):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        m = model.value
        ids, tokens = table["id"], Tokens(table["text"].to_pylist())
        if not len(tokens.grams):
            return pa.table([pa.array([], f.type) for f in SCORES], SCORES)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        count = np.concatenate([unpack(r["known"], np.int64) for r in rows])
        seen, both = (np.concatenate([unpack(r[c], np.int8) for r in rows]).astype(np.int64) for c in ("words", "pairs"))
        words, which = np.unique(tokens.grams, return_inverse=True)
        whose = np.unique(tokens.pairs, return_inverse=True)[1]
        count, seen, end = count[which], seen[which], seen[np.searchsorted(words, END)]
        before = np.roll(seen, 1)
        before[:1] = end
        base = np.log10((count + 1.0) / (m.n + 1.0 * (m.v + 1)))
        columns = [
            ids,
            tokens.lengths,
            tokens.sums((count > 0).astype(np.int64)),
            np.full(len(ids), m.n, np.int64),
            tokens.sums(base),
            tokens.sums(m.log10(seen, before, both[whose])),
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], SCORES)

    return score


def score_documents(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Train on the rows where ``training`` holds and score every row.

    Result: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    chunks, bits = chunk_plan(docs, text_col)
    shards = filter_shards(docs.filter(training).select(F.col(text_col).alias("text")), bits)
    known = spark.sparkContext.broadcast(model(shards))
    chunked = document_chunks(docs, id_col, text_col, chunks)
    asked = chunked.groupBy("chunk").applyInArrow(_asked(bits), "bucket int, chunk int, words binary, pairs binary")
    answers = (
        asked.groupBy("bucket")
        .cogroup(shards.select("bucket", "size", "bits", "hashes", "counts").groupBy("bucket"))
        .applyInArrow(_answer, "chunk int, bucket int, known binary, words binary, pairs binary")
    )
    return (
        chunked.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _scored(known),
            "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2
