"""Substring dedup: Rabin-Karp hashes of all word windows, counted in Spark, merged into removal intervals.

A window is ``window`` consecutive words of one document. A word goes if a window
over it has the same words as a window of a document with a smaller id. All
windows are judged on the input, so the result does not depend on any order.

The work runs in three steps that see every window once:

1. Documents are dealt into chunks. A chunk hashes its windows with a rolling
   polynomial and sends each distinct hash once, with the smallest document id it
   has in the chunk, to the bucket of its leading bits. A passage shared by a
   third of all documents therefore arrives once per chunk, not once per document.
2. A bucket finds the smallest id of every hash and answers each chunk with one
   bit per hash: does a smaller document outside this chunk have it?
3. The chunk rebuilds its windows, adds what it knows itself, merges the hit
   windows into maximal intervals and removes them.

Hashes have 64 bits: two different windows fall together with a chance of 2^-64.

Defined cases: a null or empty text has no words; documents shorter than the
window keep everything; rows with equal ids are one document to each other (none
removes the other's words); a null id is larger than every id. Other columns of
the input are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import (
    LARGEST_ID,
    bucket_cuts,
    chunk_plan,
    document_chunks,
    mixed,
    pack,
    pack_sorted,
    unpack,
    unpack_sorted,
    word_hashes,
)

WINDOW = 50
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp value of the window that begins at each word, from prefix sums modulo 2^64."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, len(hashes)), dtype=np.uint64)))
    return mixed((sums[window:] - sums[:-window]) * _powers(INVERSE, n))


class Chunk:
    """Words of a chunk's documents by ascending id, and their windows."""

    def __init__(self, table: pa.Table, window: int):
        rows = zip(table["id"].to_pylist(), table["text"].to_pylist())
        self.docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.words = [text.split() for _, text in self.docs]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.lengths)
        ids = np.array([LARGEST_ID if i is None else i for i, _ in self.docs], np.int64)
        hashes = window_hashes(word_hashes(list(itertools.chain.from_iterable(self.words))), window)
        begins = np.arange(len(hashes))
        owner = np.repeat(np.arange(len(ids)), self.lengths)[: len(hashes)]
        inside = begins + window <= self.ends[owner]
        self.begins, self.ids = begins[inside], ids[owner[inside]]
        # Documents ascend, so a stable order puts the smallest id of every hash first.
        order = np.argsort(hashes[inside], kind="stable")
        ranked = hashes[inside][order]
        first = np.ones(len(ranked), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        self.hashes, self.smallest = ranked[first], self.ids[order][first]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(first) - 1


def _asked(window: int, bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        chunk, out = Chunk(table, window), []
        cuts = bucket_cuts(chunk.hashes, bits)
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            out.append((int(b), key[0].as_py(), pack_sorted(chunk.hashes[part]), pack(chunk.smallest[part])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    hashes = [unpack_sorted(b) for b in table["hashes"].to_pylist()]
    ids = np.concatenate([unpack(b, np.int64) for b in table["ids"].to_pylist()])
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    smallest = np.minimum.reduceat(ids[order], first)
    hit = np.empty(len(every), bool)
    hit[order] = ids[order] > np.repeat(smallest, np.diff(np.append(first, len(every))))
    parts = np.split(hit, np.cumsum([len(h) for h in hashes])[:-1])
    bits = [pack(np.packbits(p)) for p in parts]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "hits": pa.array(bits, pa.binary())})


def _removed(window: int, bits: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        cuts = bucket_cuts(chunk.hashes, bits)
        hits = np.zeros(len(chunk.hashes), bool)
        for b, blob in zip(answers["bucket"].to_pylist(), answers["hits"].to_pylist()):
            n = cuts[b + 1] - cuts[b]
            hits[cuts[b] : cuts[b + 1]] = np.unpackbits(unpack(blob, np.uint8), count=n)
        gone = hits[chunk.which] | (chunk.ids > chunk.smallest[chunk.which])
        steps = np.zeros(int(chunk.lengths.sum()) + 1, np.int32)
        begins = chunk.begins[gone]
        np.add.at(steps, begins, 1)
        np.add.at(steps, begins + window, -1)
        covered = np.cumsum(steps[:-1]) > 0
        out = []
        for (doc_id, _), words, end in zip(chunk.docs, chunk.words, chunk.ends):
            cover = covered[end - len(words) : end]
            turns = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
            kept = words if not len(turns) else list(itertools.compress(words, ~cover))
            spans = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
        columns = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, RESULT)], RESULT)

    return remove


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per document its kept words joined by one space and the removed word intervals.

    Result: ``doc_id``, ``n_words``, ``n_removed``, ``kept``, ``spans`` (half-open
    word ranges, maximal and in order).
    """
    chunks, bits = chunk_plan(docs, text_col)
    chunked = document_chunks(docs, id_col, text_col, chunks)
    asked = chunked.groupBy("chunk").applyInArrow(
        _asked(window, bits), "bucket int, chunk int, hashes binary, ids binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, hits binary")
    return (
        chunked.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _removed(window, bits),
            "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>",
        )
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT row_no, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW}),
k AS (SELECT row_no, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS run FROM s),
f AS (SELECT row_no, doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first_id FROM k),
g AS (SELECT DISTINCT row_no, i + j AS pos FROM f, range({WINDOW}) r(j) WHERE doc_id > first_id),
w AS (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
c AS (
  SELECT row_no, count(g.pos) AS gone, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM w LEFT JOIN g USING (row_no, pos) GROUP BY row_no)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (row_no)"""
