"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Writing. Every row becomes one record in a gzip member of its own. Of the rows with
equal payloads (SHA-1 and length) the one with the largest id is the response, the
others revisit it; payloads below ``least_bytes`` are all responses. Tasks write
files of limited size under names of their own into a shared folder; the manifest
of files is a Parquet table, so files of failed or repeated attempts are never
read.

Reading. Files are cut into byte ranges that are read in parallel. A task looks for
the gzip magic from the start of its range, takes a place for a record only if the
bytes there inflate to a WARC header, and owns the records that start inside its
range, reading on past its end to finish the last. From one member to the next it
goes by the member's own end. Payload digests are recomputed and compared.

Defined cases: a null payload is empty; null ids lose to every other id, and if
all are null they are responses; rows that repeat an id and a payload are the same
kind of record; empty payloads count as equal payloads; white space and control
characters in a URL are percent-encoded, a missing URL becomes a URN; an empty
table gives no files and no records; other columns are ignored. A stored (not
deflated) payload that itself holds a whole gzip member with a WARC header may be
taken for a record when a range begins inside it; this writer always deflates.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm.common import partitions, shared_folder, written

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _files(folder: str):
    """File system and path of a folder; Spark's names for local folders included."""
    if "://" not in folder:
        folder = re.sub(r"^file:/*", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


def _uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One gzip member: a response, or a revisit of the record of ``refers_to``."""
    block = HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _writer(folder: str, file_bytes: int):
    def write(tables):
        store, top = _files(folder)
        store.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        done, out, size, records = [], None, 0, 0

        def close():
            if out is not None:
                out.close()
                done.append((path, size, records))

        path = ""
        for table in tables:
            for row in zip(*(table[c].to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                if out is None or size >= file_bytes:
                    close()
                    path, size, records = f"{top}/{name}-{len(done):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(*row)
                out.write(member)
                size, records = size + len(member), records + 1
        close()
        if done:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), MANIFEST)], schema=MANIFEST)

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write all rows below ``folder``; the manifest: ``path, bytes, records``."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    # Written: the join then sees two plain tables and can split a payload that many rows share.
    best = written(rows.groupBy("sha", "n").agg(F.max("id").alias("best"))).withColumnsRenamed({"sha": "s", "n": "m"})
    revisits = (F.col("n") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("best"))
    joined = rows.join(best, (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m"))).select(
        "id", "url", "payload", F.when(revisits, F.col("best")).alias("refers_to")
    )
    return written(joined.mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"))


def _header(raw: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


class _Window:
    """A file read forward in steps; ``at(p)`` gives the bytes from ``p`` on that are already here."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        new = self.file.read(READ_BYTES)
        self.data += new
        return bool(new)

    def drop(self, upto: int) -> None:
        self.data, self.start = self.data[upto - self.start :], max(self.start, upto)


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that begins at ``at`` and its end, or None if none does."""
    unpacker, parts, feed = zlib.decompressobj(31), [], at
    size, sure = 0, False
    while not unpacker.eof:
        if feed >= window.start + len(window.data) and not window.more():
            if sure:
                raise ValueError("archive ends inside a record")
            return None
        piece = window.data[feed - window.start : feed - window.start + READ_BYTES]
        feed += len(piece)
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error:
            if sure:
                raise
            return None
        size += len(parts[-1])
        if not sure and size >= 7:
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
            sure = True
    if not sure:
        return None
    return b"".join(parts), feed - len(unpacker.unused_data)


def read_range(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, inflated record)`` of every record that begins in ``[start, end)``."""
    window = _Window(file, start)
    at = start
    while at < end:
        found = window.data.find(MAGIC, at - window.start)
        if found < 0:
            keep = max(at, window.start + len(window.data) - 2)  # the magic may begin in the last two bytes
            at = keep
            window.drop(keep)
            if keep >= end or not window.more():
                return
            continue
        at = window.start + found
        if at >= end:
            return
        member = _inflate(window, at)
        if member is None:
            at += 1
            continue
        yield at, member[0]
        at = member[1]
        window.drop(at)


RECORDS = "path string, offset long, record_id string, type string, headers map<string,string>, payload_bytes long, payload_digest string"


def _reader(folder: str, payloads: bool):
    schema = pa.schema([*FIELDS, ("payload", pa.binary())] if payloads else FIELDS)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(tables):
        store, _ = _files(folder)
        for table in tables:
            rows, size = [], 0
            for path, start, end in zip(*(table[c].to_pylist() for c in ("path", "start", "end"))):
                with store.open_input_file(path) as file:
                    for offset, raw in read_range(file, start, end):
                        rows.append(_row(path, offset, raw))
                        size += len(raw) if payloads else 1000
                        if size > BATCH_BYTES:
                            yield packed(rows)
                            rows, size = [], 0
            if rows:
                yield packed(rows)

    return read


FIELDS = [
    ("path", pa.string()),
    ("offset", pa.int64()),
    ("record_id", pa.string()),
    ("type", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
]


def _row(path: str, offset: int, raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _header(head)
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        digest, n = said, int(headers.get("x-payload-length", 0))
    else:
        digest, n = payload_digest(payload), len(payload)
        if said and said != digest:
            raise ValueError(f"payload digest differs in {path} at {offset}")
    return path, offset, headers["warc-record-id"], headers["warc-type"], list(headers.items()), n, digest, payload


def read_archives(
    spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """One row per record of the files in ``manifest``; ``payloads`` adds the payload itself."""
    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    ranges = manifest.filter("bytes > 0").select("path", starts)
    ranges = ranges.withColumn("end", F.col("start") + split_bytes).repartition(partitions(spark), "path", "start")
    return ranges.mapInArrow(_reader(folder, payloads), RECORDS + (", payload binary" if payloads else ""))


def _id(text):
    return F.nullif(F.regexp_extract(text, r"^<urn:page:(.*)>$", 1), F.lit("None")).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per page, from the records alone."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    found = read_archives(spark, write_archives(pages, folder), folder, payloads=False)
    return found.select(
        _id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        _id(F.col("headers")["warc-refers-to"]).alias("refers_to"),
    )
