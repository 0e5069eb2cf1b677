"""Large single files read by many tasks: byte ranges whose tasks agree where records begin.

A record may hold line breaks, quotes and brackets, so what a byte means depends on
everything before it in its file. Three steps settle that without reading a file in
one task:

1. Every range is scanned by itself: how many quotes it holds (odd or even), and how
   much deeper its brackets end than they began, once if it began outside quotes and
   once if inside. An escaping backslash run before a range is looked up in its file.
2. Sums over the ranges before give each range's state: inside quotes or not, depth.
3. Every range is read again from its state. Its task owns the records whose delimiter
   lies in the range and reads on past the end of the range until the last one ends.

Step 2 handles one narrow row per range; its table is written, so step 3 reads the
same states after a lost executor. Files are read with pyarrow's file systems; other
stores, and compressed files, need Spark's own readers. Text is UTF-8.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenspark.session import written

BLOCK = 1 << 20
TAIL = 1 << 16  # read at a time behind the end of a range
BATCH = 4 << 20
TASKS = 200  # at most, unless the cores or the bytes ask for more
BOM = b"\xef\xbb\xbf"
QUOTE, BACKSLASH, NEWLINE, COMMA = b'"'[0], b"\\"[0], b"\n"[0], b","[0]
OPENERS, CLOSERS = b"{[", b"}]"
COMPRESSED = r"(?i)\.(gz|bz2|zst|zstd|lz4|snappy|xz|deflate)$"

_STEP = np.zeros(256, np.int8)
_STEP[list(OPENERS)], _STEP[list(CLOSERS)] = 1, -1
_MARK = _STEP != 0
_MARK[COMMA] = True


def open_file(uri: str) -> pa.NativeFile:
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem().open_input_file(re.sub("^(file:)?/+", "/", uri))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


# ---- marks of a block -----------------------------------------------------------------------


def quote_positions(data: np.ndarray, escapes: bool, escaped: bool) -> tuple[np.ndarray, bool]:
    """Quotes that open or close, and whether the byte after the block is escaped.

    ``escapes``: a backslash escapes the byte behind it; ``escaped``: the first byte is.
    """
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH) if escapes else quotes[:0]
    if not len(slashes):
        return (quotes[quotes > 0] if escaped else quotes), False if len(data) else escaped
    begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    ends = slashes[np.append(begins[1:], len(slashes)) - 1] + 1
    lengths = np.diff(np.append(begins, len(slashes)))
    if escaped and slashes[0] == 0:
        lengths[0] += 1  # the run goes on from the block before
    hidden = ends[lengths % 2 == 1]
    if escaped and slashes[0] != 0:
        hidden = np.append(0, hidden)
    return quotes[~np.isin(quotes, hidden)], bool(len(hidden) and hidden[-1] == len(data))


def bracket_marks(data: np.ndarray, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of brackets and commas, and whether an odd number of quotes comes before each."""
    marks = np.flatnonzero(_MARK[data])
    return marks, (np.searchsorted(quotes, marks) % 2).astype(bool)


def escaped_at(file: pa.NativeFile, start: int, escapes: bool) -> bool:
    """Whether an odd run of backslashes ends right before ``start``."""
    run, at = 0, start
    while escapes and at > 0:
        low = max(0, at - 4096)
        file.seek(low)
        data = file.read(at - low)
        own = len(data) - len(data.rstrip(b"\\"))
        run += own
        if own < len(data):
            break
        at = low
    return run % 2 == 1


def mark_length(file: pa.NativeFile, start: int) -> int:
    """Bytes of a byte order mark at the beginning of the file, 0 for ranges that begin behind it."""
    if start >= len(BOM):
        return 0
    file.seek(0)
    return len(BOM) if file.read(len(BOM)) == BOM else 0


# ---- step 1: every range by itself ----------------------------------------------------------


def scan_range(file: pa.NativeFile, start: int, end: int, json: bool) -> tuple[int, int, int]:
    """Parity of the quotes, and the change of depth if the range begins outside or inside quotes."""
    escaped, odd, changes = escaped_at(file, start, json), 0, [0, 0]
    file.seek(start)
    at = start
    while at < end:
        data = np.frombuffer(file.read(min(BLOCK, end - at)), np.uint8)
        if not len(data):
            break
        quotes, escaped = quote_positions(data, json, escaped)
        if json:
            marks, turned = bracket_marks(data, quotes)
            step = _STEP[data[marks]].astype(np.int64)
            changes[odd] += int(step[~turned].sum())
            changes[1 - odd] += int(step[turned].sum())
        odd ^= len(quotes) & 1
        at += len(data)
    return odd, *changes


def file_ranges(spark: SparkSession, path: str | list[str], split_bytes: int) -> DataFrame:
    """``path, length, start, end``: all bytes of all files, no range longer than ``split_bytes``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    refused = F.raise_error(F.concat(F.lit("compressed files cannot be split: "), "path")).cast("string")
    files = files.withColumn("path", F.when(F.col("path").rlike(COMPRESSED), refused).otherwise(F.col("path")))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    return files.select("path", "length", starts).withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))


def _scanned(json: bool):
    def scan(tables):
        for table in tables:
            rows = []
            for path, start, end in zip(*(table[c].to_pylist() for c in ("path", "start", "end"))):
                with open_file(path) as file:
                    rows.append(scan_range(file, start, end, json))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.record_batch([*table.columns, *columns], names=[*table.schema.names, "odd", "outside", "inside"])

    return scan


def _spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt out to tasks: one each while they are few, then splits of Spark's size where that makes more tasks.

    The rows that are dealt out are narrow. A task per range would make tasks, files and shuffle blocks by the range.
    """
    spark = ranges.sparkSession
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism, math.ceil(size / split_size(spark, None)))
    return ranges.repartition(max(1, min(n, tasks)))


def range_states(ranges: DataFrame, json: bool) -> DataFrame:
    """``path, length, start, end, quoted, depth``: every range with its state, as a written table.

    A file that ends inside quotes or, as JSON, inside brackets is an error.
    """
    schema = "path string, length long, start long, end long, odd long, outside long, inside long"
    found = written(_spread(ranges).mapInArrow(_scanned(json), schema))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    change = F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))
    states = found.withColumn("quoted", quoted).withColumn("change", change)
    states = states.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    whole = ((F.col("quoted") + F.col("odd")) % 2 == 0) & (F.lit(not json) | (F.col("depth") + F.col("change") == 0))
    broken = F.raise_error(F.concat(F.lit("malformed: quotes or brackets stay open in "), "path")).cast("long")
    depth = F.when((F.col("end") < F.col("length")) | whole, F.col("depth")).otherwise(broken).alias("depth")
    return written(states.select("path", "length", "start", "end", "quoted", depth))


# ---- step 3: the records of a range ---------------------------------------------------------


def csv_records(file: pa.NativeFile, start: int, end: int, length: int, quoted: int) -> Iterator[bytes]:
    """The records whose line break (or the file's beginning) lies in the range, without their own line break."""
    at, parts, mark = start, [] if start == 0 else None, mark_length(file, start)
    file.seek(start)
    while at < length and (at < end or parts is not None):
        raw = file.read(min(BLOCK, end - at) if at < end else min(TAIL, length - at))
        data = np.frombuffer(raw, np.uint8)
        quotes, _ = quote_positions(data, False, False)
        begin = min(len(raw), max(0, mark - at))
        breaks = np.flatnonzero(data == NEWLINE)
        breaks = breaks[(np.searchsorted(quotes, breaks) + quoted) % 2 == 0]
        for stop in breaks.tolist():
            if parts is not None:
                parts.append(raw[begin:stop])
                yield b"".join(parts).removesuffix(b"\r")
            if at >= end:
                return
            parts, begin = [], stop + 1
        if parts is not None:
            parts.append(raw[begin:])
        quoted = (quoted + len(quotes)) % 2
        at += len(raw)
    if parts and (last := b"".join(parts)):
        yield last


def json_records(
    file: pa.NativeFile, start: int, end: int, length: int, quoted: int, depth: int, whole: bool = False
) -> Iterator[bytes]:
    """The entries of the outermost object or list whose opening bracket or comma lies in the range.

    An entry is ``"key": value`` of an object or a value of a list, as it stands in
    the file. With ``whole`` the outermost object or list itself is the only entry.
    """
    escaped = escaped_at(file, start, True)
    at, parts, comma, mark = start, None, False, mark_length(file, start)
    file.seek(start)
    while at < length and (at < end or parts is not None):
        raw = file.read(min(BLOCK, end - at) if at < end else min(TAIL, length - at))
        data = np.frombuffer(raw, np.uint8)
        quotes, escaped = quote_positions(data, True, escaped)
        marks, turned = bracket_marks(data, quotes)
        marks = marks[turned == bool(quoted)]
        step = _STEP[data[marks]].astype(np.int64)
        after = depth + np.cumsum(step)
        edge = (np.maximum(after, after - step) == 1) & ((step != 0) & (np.minimum(after, after - step) == 0) | (step == 0) & (not whole))
        begin = min(len(raw), max(0, mark - at))
        level = depth
        for stop, change in zip(marks[edge].tolist(), step[edge].tolist()):
            if level == 0 and raw[begin:stop].strip():
                raise ValueError("malformed JSON: text outside the outermost object or list")
            if parts is not None:
                parts.append(raw[begin : stop + (whole and change < 0)])
                entry = b"".join(parts)
                if entry.strip():
                    yield entry
                elif change == 0 or comma:
                    raise ValueError("malformed JSON: nothing beside a comma")
            if at >= end:
                return
            parts, level, comma = (None, 0, False) if change < 0 else ([], 1, change == 0)
            begin = stop if whole and change > 0 else stop + 1
        if parts is not None:
            parts.append(raw[begin:])
        elif level == 0 and at < end and raw[begin:].strip():
            raise ValueError("malformed JSON: text outside the outermost object or list")
        quoted = (quoted + len(quotes)) % 2
        depth = int(after[-1]) if len(after) else depth
        at += len(raw)


def first_byte(file: pa.NativeFile) -> bytes:
    """The first byte that is no white space and no byte order mark."""
    file.seek(0)
    while raw := file.read(4096):
        if raw := raw.removeprefix(BOM).lstrip():
            return raw[:1]
    return b""


Reader = Callable[[pa.NativeFile, dict], Iterator[bytes]]


def read_records(states: DataFrame, reader: Reader) -> DataFrame:
    """``value``: the records that ``reader`` finds in each range, as text."""

    def read(tables):
        for table in tables:
            for row in table.to_pylist():
                with open_file(row["path"]) as file:
                    held, size = [], 0
                    for record in reader(file, row):
                        held.append(record)
                        size += len(record) + 16
                        if size > BATCH:
                            yield pa.record_batch({"value": pa.array(held, pa.binary())})
                            held, size = [], 0
                    if held:
                        yield pa.record_batch({"value": pa.array(held, pa.binary())})

    return _spread(states).mapInArrow(read, "value binary").select(F.col("value").cast("string").alias("value"))


def split_size(spark: SparkSession, split_bytes: int | None) -> int:
    """The given size, or the one by which Spark splits files."""
    if split_bytes is not None:
        return split_bytes
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def longest_file(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file that can be split, 0 if there is none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.filter(~F.col("path").rlike(COMPRESSED)).agg(F.max("length")).first()[0] or 0
