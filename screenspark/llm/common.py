"""What the corpus operators share: the shared folder, words, hashes, packed arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a maximal run of anything but ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LARGEST_ID = np.iinfo(np.int64).max
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Only a local master without that setting gets a scratch folder; a cluster
    without it is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        base = _FOLDERS.setdefault(app, tempfile.mkdtemp(prefix="run-"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def document_chunks(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """``(chunk, id, text as bytes)`` with a chunk that depends on nothing but the row.

    A null text counts as empty. Every reader that groups by ``chunk`` sees the
    same documents in a chunk, also after a lost executor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunk = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int")
    return docs.select(
        chunk.alias("chunk"), F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text")
    )


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small numbers cost little whatever their type."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as packed differences."""
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20


def chunk_plan(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Chunks to deal documents into, and leading hash bits that name a bucket.

    Both grow with the text: a chunk has some ``CHUNK_BYTES`` of it, a bucket what
    ``BUCKET_BYTES`` of it give; there are at least two of each per shuffle partition.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = 2 * partitions(docs.sparkSession)
    chunks, buckets = max(least, -(-total // CHUNK_BYTES)), max(least, -(-total // BUCKET_BYTES), 16)
    return chunks, (buckets - 1).bit_length()


def bucket_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets begins in ascending hashes; one more entry for the end."""
    firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(hashes, firsts), [len(hashes)]))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], size: str, name: str) -> DataFrame:
    """``name``: the sum of ``size`` up to and including each row, in the order of ``bucket`` and then ``order``.

    Exact inside each bucket and shifted by the sums of the buckets before it, so
    no window spans a key. ``bucket`` must ascend with ``order``.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("in_range"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(k).alias(f"s_{k}") for k in [*keys, bucket]],
        F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("shift"),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match = [F.col(k) == F.col(f"s_{k}") for k in [*keys, bucket]]
    summed = df.withColumn("so_far", F.sum(size).over(inside)).join(shifts, match)
    return summed.withColumn(name, F.col("shift") + F.col("so_far")).select(*df.columns, name)
