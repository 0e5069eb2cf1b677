"""Document fingerprints by randomised edit embedding.

All texts walk over their characters with the same random bits: step j reads the
current character c, and a bit drawn for (j, c) says whether to move on or to read
c once more. Two texts within a small edit distance soon walk in step again after
every edit, so their sequences of read characters differ in few steps: edit
distance has become Hamming distance.

A fingerprint samples those steps. At level k one step is drawn from every block
of ``2**k`` steps, always one of the two drawn at level k - 1, and its character is
hashed to a hex digit. The level grows with the length, so a fingerprint has up to
about 256 digits whatever the length, and fingerprints of different levels are
compared at the higher one. Walks cover whole texts. The likeness of two
fingerprints is the share of equal digits in the longer one, cleared of the 1/16
that agree by chance.

Near texts: each fingerprint is entered under bands of sampled digits of its own level.
A band takes its digits from one span of ``SPAN`` digits, and the spans cover the
whole fingerprint, so texts may differ anywhere. One that is close to the length of the
next level is entered at that level too, where it meets the near texts beyond; short
ones, which have few spans, at the next two levels. Fingerprints that share a band and have at least
``threshold`` likeness are linked; components are closed over all links. Bands
with a single fingerprint are dropped before any fingerprint is sent. A band of
more than ``BAND_LIMIT`` different fingerprints is cut into blocks of about that
many, and every two blocks are compared by themselves: no link is lost, and a task
compares two blocks at most.

Defined cases: a null text is empty; fingerprints of empty texts are alike, an
empty and another one are not; rows that repeat an id follow each other by a hash
of their text; null ids come after all others; the next document of the only
document is itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import mixed, partitions, written
from screenspark.llm.components import stars
from screenspark.llm.simhash import merge
from screenspark.session import discard

CLASSES = 64  # characters are hashed to so many classes
PERIOD = 8192  # steps after which the drawn bits repeat
SMALLEST = 64  # characters of the shortest text of level 1 is twice this
BATCH_CHARS = 40 << 20
CHECK = 64  # steps between looks at which texts have ended; divides PERIOD
LEVELS = "0123456789abcdefghijklmnopqrstuvwxyz"
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
THRESHOLD = 0.8
BANDS, ROWS, SPAN = 4, 8, 32  # bands per span, digits of a band, digits they are drawn from
# Fingerprints below so many digits are entered at three levels, those of so many at two.
SHORT, NEXT = 128, 192
BAND_LIMIT = 1 << 12


def _drawn(salt: int, n: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_MOVES = np.ascontiguousarray(
    (_drawn(1, PERIOD)[:, None] >> np.arange(CLASSES, dtype=np.uint64)[None, :]) & np.uint64(1)
).astype(np.uint8)
_DIGITS = (_drawn(2, PERIOD * CLASSES).reshape(PERIOD, CLASSES) & np.uint64(15)).astype(np.uint8)
_MOVES, _DIGITS = (np.concatenate((t, np.full((PERIOD, 1), end, np.uint8)), axis=1) for t, end in ((_MOVES, 0), (_DIGITS, 255)))
_CLASS = (mixed(np.arange(0x110000)) & np.uint64(CLASSES - 1)).astype(np.uint8)


@functools.cache
def _first_turns(level: int) -> np.ndarray:
    return _turn(level, np.arange(512))


def _turn(level: int, block: np.ndarray) -> np.ndarray:
    """Which of the two steps of the level below a block of ``level`` takes."""
    return (mixed(block.astype(np.uint64) + np.uint64(level << 48)) & np.uint64(1)).astype(np.int64)


def _levels(steps: np.ndarray, highest: int) -> np.ndarray:
    """The highest level that samples each step."""
    out, alive = np.zeros(len(steps), np.int64), np.arange(len(steps))
    for level in range(1, highest + 1):
        part = steps[alive]
        alive = alive[(part >> (level - 1) & 1) == _turn(level, part >> level)]
        out[alive] = level
    return out


def level_of(n_chars: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.frexp(np.maximum(n_chars, 1) / SMALLEST)[1] - 1)


def _walk(texts: list[str]) -> list[str]:
    """Fingerprints of some texts, all walked at once."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths, level = lengths[order], level_of(lengths[order])
    classes = np.full(int(lengths.sum()) + len(texts) + CHECK, CLASSES, np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    for i, a, n in zip(order.tolist(), starts.tolist(), lengths.tolist()):
        classes[a : a + n] = _CLASS[np.frombuffer(texts[i].encode("utf-32-le"), np.uint32)]
    ends, at = starts + lengths, starts.copy()
    digits, count = np.full((len(texts), 512), 255, np.uint8), np.zeros(len(texts), np.int64)
    alive, step = len(texts) - int((lengths == 0).sum()), 0
    live = np.arange(alive)
    while len(live):
        here, low = at[live], level[live]
        sampled = _levels(np.arange(step, step + CHECK), int(low[0]))
        # Longer texts come first, so the levels descend: the ones that sample a step are the last.
        firsts = np.searchsorted(-low, -sampled).tolist()
        row = step % PERIOD
        for moves, drawn, first in zip(_MOVES[row : row + CHECK], _DIGITS[row : row + CHECK], firsts):
            read = classes.take(here)
            if first < len(live):
                who = live[first:]
                column = count[who]
                if column.max() >= digits.shape[1]:
                    digits = np.concatenate((digits, np.full_like(digits, 255)), axis=1)
                digits[who, column] = drawn[read[first:]]
                count[who] += 1
            here += moves.take(read)
        at[live] = here
        live = live[here < ends[live]]
        step += CHECK
    out = [""] * len(texts)
    for i, row, lev, n in zip(order.tolist(), digits, level.tolist(), count.tolist()):
        found = row[:n]
        out[i] = LEVELS[lev] + HEX[found[found < 16]].tobytes().decode()
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Level and hex digits of every text; texts are walked in batches of limited size."""
    out, batch, size = [], [], 0
    for text in texts:
        batch.append(text)
        size += len(text)
        if size > BATCH_CHARS:
            out += _walk(batch)
            batch, size = [], 0
    return out + (_walk(batch) if batch else [])


def _split(fp: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(fp.encode(), np.uint8)
    return LEVELS.index(fp[0]), raw[1:]


def _raised(level: int, digits: np.ndarray, to: int) -> np.ndarray:
    while level < to:
        level += 1
        block = np.arange((len(digits) + 1) // 2)
        taken = 2 * block + (_first_turns(level)[: len(block)] if len(block) <= 512 else _turn(level, block))
        digits = digits[taken[taken < len(digits)]]
    return digits


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (la, x), (lb, y) = _split(a), _split(b)
    x, y = _raised(la, x, max(la, lb)), _raised(lb, y, max(la, lb))
    n, most = min(len(x), len(y)), max(len(x), len(y))
    if n == 0:
        return 0.0
    return max(0.0, (float((x[:n] == y[:n]).sum()) / most - 1 / 16) / (15 / 16))


# ---- documents in descending id order, each with its next -------------------------------


def _pressed(tables):
    press = zstandard.ZstdCompressor(level=1).compress
    for t in tables:
        blobs = [press(x) for x in t["text"].to_pylist()]
        yield pa.record_batch([t["place"], t["copy"], t["id"], t["tie"], pa.array(blobs, pa.binary())], names=PRESSED)


PRESSED = ["place", "copy", "id", "tie", "blob"]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Partitions in which documents descend by id; the row that follows a stretch ends it as a copy.

    The stretches end at ids that quantiles of all ids name, a few per shuffle
    partition. Texts travel compressed.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    n = 2 * partitions(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    shares = F.lit([i / n for i in range(1, n)])
    low, cuts, high = ids.agg(F.min("id"), F.percentile_approx("id", shares, 50 * n), F.max("id")).first()
    # Largest id of every stretch, ascending. Ids up to and including a cut lie below it.
    tops = sorted({*(cuts or []), *([high] if high is not None else [])})
    stretch = F.lit(0) if not tops else F.coalesce(F.array_size(F.filter(F.lit(tops), lambda t: t < F.col("id"))), F.lit(0))
    own = rows.select(stretch.cast("int").alias("place"), F.lit(False).alias("copy"), "*")
    if len(tops) > 1:
        after = F.when(F.col("id") == high, 0).otherwise(stretch + 1)
        ends = rows.filter(F.col("id").isin(tops)).select(after.cast("int").alias("place"), F.lit(True).alias("copy"), "*")
    else:
        top = rows if high is None else rows.filter(F.col("id") == high)
        ends = top.select(F.lit(0).alias("place"), F.lit(True).alias("copy"), "*")
    pressed = own.unionByName(ends).mapInArrow(_pressed, "place int, copy boolean, id long, tie long, blob binary")
    dealt = pressed.repartition(partitions(spark), "place")
    return dealt.sortWithinPartitions("place", "copy", F.desc_nulls_last("id"), "tie")


def _with_next(tables) -> Iterator[list[tuple]]:
    """Batches of ``(id, text, next text)``."""
    open_ = zstandard.ZstdDecompressor().decompress
    held, out, size = None, [], 0
    for t in tables:
        for place, copy, doc_id, blob in zip(*(t[c].to_pylist() for c in ("place", "copy", "id", "blob"))):
            if copy and (held is None or held[0] != place):
                continue  # further rows with the id of the copy that ended the stretch
            text = open_(blob).decode()
            if held is not None:
                out.append((held[1], held[2], text))
                size += len(held[2])
            held = None if copy else (place, doc_id, text)
            if size > BATCH_CHARS // 2:
                yield out
                out, size = [], 0
    if out:
        yield out


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compared(tables):
    for rows in _with_next(tables):
        edited = []
        for _, text, after in rows:
            n = len(text) // 3
            edited.append(text[: len(text) - n] + after[:n])
        # A text that follows another one here is walked once.
        texts = list(dict.fromkeys([x for _, text, after in rows for x in (text, after)] + edited))
        found = dict(zip(texts, fingerprints(texts)))
        out = []
        for (doc_id, text, after), new in zip(rows, edited):
            own, other = found[text], found[new]
            sha = hashlib.sha256(new.encode()).hexdigest()
            out.append((doc_id, len(text), sha, own, other, likeness(own, other), likeness(own, found[after])))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses (see the module's text)."""
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return in_order(docs, id_col, text_col).mapInArrow(_compared, f"{kinds}, near_edited double, near_next double")


# ---- near texts ---------------------------------------------------------------------------


@functools.cache
def _places(rows: int, band: int, start: int, width: int) -> np.ndarray:
    drawn = mixed(np.arange(rows, dtype=np.uint64) + np.uint64(band * 1000 + (start << 20)))
    return start + (drawn % np.uint64(width)).astype(np.int64)


def band_keys(fp: str, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Keys under which a fingerprint meets others: sampled digits of every span, at one to three levels.

    A band of the last, partly filled span counts if all its digits are there.
    Fingerprints below two spans also have bands in their largest power of two and half of it.
    """
    return _band_keys(*_split(fp), bands, rows)


def _band_keys(level: int, digits: np.ndarray, bands: int, rows: int) -> list[int]:
    keys = []
    for to in range(level, level + (3 if len(digits) < SHORT else 1 + (len(digits) >= NEXT))):
        x = _raised(level, digits, to)
        spans = {(start, SPAN) for start in range(0, len(x), SPAN)}
        if len(x) < 2 * SPAN:
            most = 1 << max(0, len(x).bit_length() - 1)
            spans |= {(0, width) for width in (most, most // 2) if width and len(x)}
        for start, width in sorted(spans):
            for band in range(bands):
                places = _places(rows, band, start, width)
                if places.max() < len(x):
                    taken = x[places].tobytes()
                    keys.append(xxhash.xxh3_64_intdigest(bytes([to, width, band]) + start.to_bytes(8, "little") + taken))
    return keys


def packed(fingerprint: Column) -> Column:
    """A fingerprint as bytes: its level, whether its last digit is a filler, its digits two to a byte."""
    digits = F.substring(fingerprint, 2, 1 << 30)
    odd = F.length(digits) % 2
    blob = F.unhex(F.concat(digits, F.when(odd == 1, "0").otherwise("")))
    return F.concat(F.substring(fingerprint, 1, 1).cast("binary"), odd.cast("string").cast("binary"), blob)


def _unpacked(blob: bytes) -> tuple[int, np.ndarray]:
    """Level and digits, as ``_split`` gives them."""
    raw = np.frombuffer(blob, np.uint8)[2:]
    digits = HEX[np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)]
    return LEVELS.index(chr(blob[0])), digits[: len(digits) - (blob[1:2] == b"1")]


def _banded(tables):
    for t in tables:
        keys, nodes = [], []
        for node, fp in zip(t["node"].to_pylist(), t["fp"].to_pylist()):
            found = set(_band_keys(*_unpacked(fp), BANDS, ROWS))
            keys += found
            nodes += [node] * len(found)
        yield pa.record_batch({"key": pa.array(np.array(keys, np.uint64).view(np.int64)), "node": pa.array(nodes, pa.int64())})


def _cells(limit: int) -> Column:
    """``(key, side)`` of every pair of blocks of its band that holds a row of ``key, n, node``.

    Block i meets itself under one key and every other block j under another,
    where the smaller number is side 0. A band within the limit is one block.
    """
    blocks = F.ceil(F.col("n") / limit)
    own = F.pmod(F.xxhash64("node"), blocks)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1),
        lambda other: F.struct(
            F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("key"),
            F.when(own == other, F.lit(-1)).otherwise((own > other).cast("int")).alias("side"),
        ),
    )


def _matrix(fps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digits of some fingerprints at their highest level, one row each, and their numbers."""
    parts = [_unpacked(f) for f in fps]
    top = max(level for level, _ in parts)
    rows = [_raised(level, x, top) for level, x in parts]
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, int(n.max()))), np.uint8)
    for r, row in zip(out, rows):
        r[: len(row)] = row
    return out, n


def _band_links(nodes: np.ndarray, sides: np.ndarray, fps: list[bytes], threshold: float):
    """Links that span the components of one band; pairs of one component are not compared again.

    Of two blocks, only pairs with one fingerprint in each are compared; inside, each block is compared elsewhere.
    """
    digits, n = _matrix(fps)
    label = np.arange(len(fps))
    for i in range(len(fps) - 1):
        apart = label[i + 1 :] != label[i]
        if sides[i] >= 0:
            apart &= sides[i + 1 :] != sides[i]
        others = i + 1 + np.flatnonzero(apart)
        if not len(others):
            continue
        same = ((digits[others] == digits[i]) & (digits[others] > 0)).sum(axis=1)
        share = same / np.maximum(1, np.maximum(n[others], n[i]))
        close = others[(share - 1 / 16) / (15 / 16) >= threshold]
        label = merge(label, close, np.full(len(close), i))
    moved = label != np.arange(len(fps))
    return nodes[moved], nodes[label[moved]]


def _linked(threshold: float):
    def found(members):
        nodes, sides, fps = zip(*members)
        return _band_links(np.array(nodes), np.array(sides), list(fps), threshold)

    def link(tables):
        key, members = None, []
        for t in tables:
            a, b = [], []
            for k, *member in zip(*(t[c].to_pylist() for c in ("key", "node", "side", "fp"))):
                if k != key:
                    if len(members) > 1:
                        links = found(members)
                        a += links[0].tolist()
                        b += links[1].tolist()
                    key, members = k, []
                members.append(member)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        if len(members) > 1:
            links = found(members)
            yield pa.record_batch({"a": pa.array(links[0]), "b": pa.array(links[1])})

    return link


def _node(fingerprint: str = "fingerprint") -> Column:
    """A fingerprint's number: 64 bits of hash, by which rows are joined."""
    return F.xxhash64(fingerprint).alias("node")


def _node_groups(rows: DataFrame, threshold: float, band_limit: int) -> DataFrame:
    """``(node, group_id)`` of every different fingerprint."""
    spark = rows.sparkSession
    each = rows.select(_node(), packed(F.col("fingerprint")).alias("fp"), "doc_id")
    nodes = written(each.groupBy("node", "fp").agg(F.min("doc_id").alias("least")))
    # Tables on both sides of a join are written, so that it can split a hot key.
    keys = written(nodes.select("node", "fp").mapInArrow(_banded, "key long, node long"))
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    cells = keys.join(sizes, "key").select("node", F.inline(_cells(band_limit)))
    met = cells.join(nodes.select("node", "fp"), "node").select("key", "node", "side", "fp")
    grouped = met.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
    root = stars(grouped.mapInArrow(_linked(threshold), "a long, b long"))
    discard(keys)
    discard(sizes)
    placed = written(
        nodes.join(root, F.col("node") == F.col("a"), "left").select("node", "least", F.coalesce("b", "node").alias("root"))
    )
    discard(nodes)
    heads = written(placed.groupBy("root").agg(F.min("least").alias("group_id")))
    return placed.join(heads, "root").select("node", "group_id")


def near_groups(rows: DataFrame, threshold: float = THRESHOLD, band_limit: int = BAND_LIMIT) -> DataFrame:
    """``(fingerprint, group_id)``: the smallest id reachable over links, from rows with ``doc_id, fingerprint``."""
    found = rows.select("fingerprint", _node()).distinct()
    return found.join(_node_groups(rows, threshold, band_limit), "node").select("fingerprint", "group_id")


def with_groups(rows: DataFrame, threshold: float = THRESHOLD, band_limit: int = BAND_LIMIT) -> DataFrame:
    """``rows``, a written table with ``doc_id, fingerprint``, and ``group_id`` of every row."""
    groups = written(_node_groups(rows, threshold, band_limit))
    return rows.withColumn("node", _node()).join(groups, "node").drop("node")
