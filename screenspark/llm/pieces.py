"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

The vocabulary of a SentencePiece model spans a lattice over a text: an edge for
every piece that occurs, and for a character without a piece an edge of its byte
pieces. A piece of rank r (from its score) has probability proportional to
``1 / (r + 1)``, raised to ``sharpness``. Forward filtering sums the probability of
all ways to every place; backward sampling walks from the end, choosing each edge
by its share. The draws come from the row key, so a row is always cut the same way.

No piece reaches over a space that follows another character, so the lattice falls
apart into chunks (spaces and the word after them). Forward sums are computed once
per distinct chunk of a block, for all chunks side by side; sampling runs for all
chunk occurrences side by side. A vocabulary in which a piece does reach over is
refused. A block has ``BATCH_CHARS`` characters of some rows, or of a part of a long
text that ends between two chunks; only a chunk (a word) is never cut.

Decoding joins the pieces' bytes. It restores every text exactly: spaces are the
only characters written as the space mark, a space mark in a text is written in
bytes, and nothing is normalised, added or stripped.

Defined cases: a null text gives null ids, an empty one no ids; rows with equal keys
and texts are cut alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from screenspark.llm.common import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS, SEED = 1.0, 11
SPACE, LITERAL = 0x2581, 0x110001  # the space mark, and a stand-in for one that the text itself holds
CHUNK = re.compile(r" *[^ \n]+| +|\n+")
BATCH_CHARS = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MAX_MODEL_BYTES = 64 << 20
ALL = (1 << 64) - 1


class Vocabulary:
    """Pieces, their log probabilities, and a table of all beginnings of pieces."""

    def __init__(self, model: bytes, sharpness: float):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in names.values()):
            raise ValueError("a piece of this model reaches over a space")
        byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("this model has no byte pieces, so its decoding loses characters")
        self.bytes = np.array([byte[b] for b in range(256)], np.int32)
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in plain], kind="stable"), kind="stable")
        logp = np.full(n, -np.log(2.0 * len(plain)) * sharpness)
        logp[plain] = -np.log(rank + 1.0) * sharpness
        top = logp[plain].max()
        self.logp = logp - (top + np.log(np.exp(logp[plain] - top).sum()))
        self.raw = [b""] * n
        for i, p in names.items():
            self.raw[i] = p.replace("▁", " ").encode()
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        # Every beginning of a piece under the hash of its characters, with the piece's id if it is whole.
        found: dict[int, int] = {}
        for i, p in names.items():
            h = 0
            for at, c in enumerate(p):
                h = (h * int(MULTIPLIER) + ord(c) + 1) & ((1 << 64) - 1)
                found[h] = i if at == len(p) - 1 else found.get(h, -1)
        self.longest = max(map(len, names.values()))
        bits = max(10, (8 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(found), np.uint64)
        ids = np.array(list(found.values()), np.int32)
        # Open addressing: each key lies in the first free slot from its own on.
        slots = (mixed(keys) >> self.shift).astype(np.int64)
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.ids = np.full(len(self.keys), -2, np.int32)
        self.reach = 0
        for key, id_, slot in zip(keys, ids, slots.tolist()):
            step = 0
            while self.ids[slot + step] != -2:
                step += 1
            self.keys[slot + step], self.ids[slot + step] = key, id_
            self.reach = max(self.reach, step)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece, -1 for the beginning of one, -2 for neither."""
        slot = (mixed(hashes) >> self.shift).astype(np.int64)
        out = np.full(len(hashes), -2, np.int32)
        left = np.arange(len(hashes))
        for step in range(self.reach + 1):
            at = slot[left] + step
            same = self.keys[at] == hashes[left]
            out[left[same]] = self.ids[at[same]]
            left = left[~same & (self.ids[at] != -2)]
            if not len(left):
                break
        return out


class Lattice:
    """Edges into every place of some chunks, with the cumulated shares of backward sampling."""

    def __init__(self, chunks: list[str], voc: Vocabulary):
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int32)
        codes = np.where(codes == SPACE, LITERAL, np.where(codes == 0x20, SPACE, codes))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        limit = np.repeat(ends, sizes)  # where the chunk of each character ends
        # Places are numbered so that chunk k owns size + 1 of them.
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        place = (np.arange(len(codes)) + np.repeat(np.arange(len(chunks)), sizes)).astype(np.int32)
        begin, length, piece = [], [], []
        alive, hashes = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.uint64)
        known = np.zeros(len(codes), bool)
        for n in range(1, voc.longest + 1):
            alive = alive[alive + n <= limit[alive]]
            if not len(alive):
                break
            hashes[alive] = hashes[alive] * MULTIPLIER + codes[alive + n - 1].astype(np.uint64) + np.uint64(1)
            found = voc.look_up(hashes[alive])
            whole = found >= 0
            begin.append(alive[whole])
            length.append(np.full(int(whole.sum()), n, np.int8))
            piece.append(found[whole])
            if n == 1:
                known[alive[whole]] = True
            alive = alive[found > -2]
        bare = np.flatnonzero(~known).astype(np.int32)  # written in bytes: -1 - code point
        # Longest pieces first: they are the likely ones and are then tried first.
        begin = np.concatenate([*begin[::-1], bare])
        length = np.concatenate([*length[::-1], np.ones(len(bare), np.int8)])
        code = np.where(codes[bare] == LITERAL, SPACE, codes[bare])
        piece = np.concatenate([*piece[::-1], -1 - code])
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        logp = np.where(piece >= 0, voc.logp[np.maximum(piece, 0)], 0.0)
        logp[len(logp) - len(bare) :] = n_bytes * voc.logp[voc.bytes[0]]
        source = place[begin]
        target = source + length
        order = np.argsort(target, kind="stable").astype(np.int32)
        source, target, self.piece, logp = source[order], target[order], piece[order], logp[order]
        del order, begin, length, hashes, place, piece
        self.source = source
        total = int(self.last[-1]) + 1 if len(chunks) else 0
        self.edges = np.searchsorted(target, np.arange(total + 1))
        self._filter(source, target, logp, total)

    def _filter(self, source, target, logp, total):
        """Forward sums place by place, for all chunks at once."""
        forward = np.zeros(total)
        column = np.arange(total) - np.repeat(self.first, self.last - self.first + 1)
        by_column = np.argsort(column, kind="stable")
        cuts = np.searchsorted(column[by_column], np.arange(int(column.max(initial=0)) + 2))
        share = np.empty(len(source))
        for a, b in zip(cuts[1:-1], cuts[2:]):
            places = by_column[a:b]
            counts = self.edges[places + 1] - self.edges[places]
            heads = np.cumsum(counts) - counts
            edge = np.repeat(self.edges[places] - heads, counts) + np.arange(int(counts.sum()))
            value = forward[source[edge]] + logp[edge]
            peak = np.maximum.reduceat(value, heads)
            part = np.exp(value - np.repeat(peak, counts))
            whole = np.add.reduceat(part, heads)
            forward[places] = peak + np.log(whole)
            share[edge] = part / np.repeat(whole, counts)
        # Cumulated shares of each place; its last edge takes what rounding leaves.
        run = np.cumsum(share)
        self.upto = run - np.concatenate(([0.0], run))[self.edges[target]]
        self.upto[self.edges[1:][np.diff(self.edges) > 0] - 1] = 1.0

    def sample(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of edges of each chunk occurrence, and all edges in reading order."""
        at, alive = self.last[chunk].copy(), np.arange(len(chunk))
        steps, whose, edges = 0, [], []
        while len(alive):
            step = np.uint64(steps * int(MULTIPLIER) & ALL)
            draw = (mixed(key[alive] + step) >> np.uint64(11)) * 2.0**-53
            edge = self.edges[at[alive]]
            past = np.flatnonzero(draw >= self.upto[edge])
            while len(past):
                edge[past] += 1
                past = past[draw[past] >= self.upto[edge[past]]]
            whose.append(alive)
            edges.append(edge)
            at[alive] = self.source[edge]
            alive = alive[at[alive] > self.first[chunk[alive]]]
            steps += 1
        count = np.bincount(np.concatenate(whose), minlength=len(chunk)) if whose else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int64)
        for step, (who, edge) in enumerate(zip(whose, edges)):
            out[ends[who] - 1 - step] = edge
        return count, out


def _utf8(code: int) -> bytes:
    return chr(code).encode()


def encode_texts(
    texts: list[str], keys: np.ndarray, voc: Vocabulary, before: np.ndarray | int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each text, and all ids; ``before`` counts the chunks of its row before each text."""
    chunks = [CHUNK.findall(t) for t in texts]
    per_text = np.fromiter(map(len, chunks), np.int64, len(chunks))
    if not per_text.any():
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
    every = list(itertools.chain.from_iterable(chunks))
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    which = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    lattice = Lattice(list(number), voc)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(per_text) - per_text - before, per_text)
    key = mixed(np.repeat(keys, per_text) ^ mixed(nth.astype(np.uint64)))
    count, edges = lattice.sample(which, key)
    ids = lattice.piece[edges]
    owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), count)
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        raw = [_utf8(-1 - c) for c in ids[bare].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bare] = [len(r) for r in raw]
        out = np.repeat(ids, width)
        out[np.repeat(ids < 0, width)] = voc.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        ids, owner = out, np.repeat(owner, width)
    return np.bincount(owner, minlength=len(texts)), ids.astype(np.int32)


_LOADED: dict[tuple, Vocabulary] = {}


def _vocabulary(model, sharpness: float) -> Vocabulary:
    """One per worker process."""
    key = (model.id if hasattr(model, "id") else 0, sharpness)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model.value, sharpness)
    return _LOADED[key]


def _parts(text: str) -> Iterator[tuple[str, int]]:
    """A text cut between chunks into parts of some ``BATCH_CHARS`` characters, and the number of chunks before each."""
    if len(text) <= BATCH_CHARS:
        yield text, 0
        return
    begin, before = 0, 0
    for n, chunk in enumerate(CHUNK.finditer(text)):
        if chunk.end() - begin > BATCH_CHARS and chunk.start() > begin:
            yield text[begin : chunk.start()], before
            begin, before = chunk.start(), n
    yield text[begin:], before


def _row_ids(texts: list[str | None], keys: list[int], voc: Vocabulary) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For some rows at a time: the row behind the last one, the number of ids of each row, and the ids in order."""
    rows, parts, before, size = [], [], [], 0
    first, counts, found = 0, np.zeros(len(texts), np.int64), []
    for row, text in enumerate(texts):
        for part, n in _parts(text or ""):
            rows.append(row)
            parts.append(part)
            before.append(n)
            size += len(part)
            if size >= BATCH_CHARS:
                count, ids = encode_texts(parts, np.array([keys[r] for r in rows], np.uint64), voc, np.array(before))
                np.add.at(counts, rows, count)
                found.append(ids)
                rows, parts, before, size = [], [], [], 0
        if found and not parts:
            yield row + 1, counts[first : row + 1], found
            first, found = row + 1, []
    if parts:
        count, ids = encode_texts(parts, np.array([keys[r] for r in rows], np.uint64), voc, np.array(before))
        np.add.at(counts, rows, count)
        found.append(ids)
    if first < len(texts):
        yield len(texts), counts[first:], found


def _encoded(model, sharpness: float, seed: int):
    def encode(tables):
        voc = _vocabulary(model, sharpness)
        for batch in tables:
            texts = batch["text"].to_pylist()
            keys = [xxhash.xxh3_64_intdigest(k or "", seed) for k in batch["key"].to_pylist()]
            kept, first = [c for c in batch.schema.names if c not in ("key", "text")], 0
            for end, counts, found in _row_ids(texts, keys, voc):
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = pa.array([t is None for t in texts[first:end]])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=null)
                part = batch.slice(first, end - first)
                yield pa.record_batch([*(part[c] for c in kept), lists], names=[*kept, "ids"])
                first = end
                del found, lists
                pa.default_memory_pool().release_unused()

    return encode


def _decoded(model, sharpness: float):
    def decode(tables):
        raw = _vocabulary(model, sharpness).raw
        for batch in tables:
            offsets, values = batch["ids"].offsets.to_pylist(), batch["ids"].values.to_numpy(zero_copy_only=False)
            texts = [
                b"".join(map(raw.__getitem__, values[a:b].tolist())).decode() if ok else None
                for a, b, ok in zip(offsets, offsets[1:], batch["ids"].is_valid().to_pylist())
            ]
            columns = [batch["doc_id"], batch["ids"], pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "ids", "text"])

    return decode


def _model(df: DataFrame, model: str):
    blob = Path(model).read_bytes()
    if len(blob) > MAX_MODEL_BYTES:
        raise ValueError("a vocabulary file of this size is not broadcast")
    return df.sparkSession.sparkContext.broadcast(blob)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``ids``: a sampled segmentation of every text, drawn from the row's id."""
    kept = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(id_col).cast("string").alias("key"),
        F.col(text_col).alias("text"),
    )
    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    out = rows.mapInArrow(_encoded(_model(docs, model), sharpness, seed), schema)
    return out.select("doc_id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``."""
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(_model(encoded, model), SHARPNESS), f"doc_id {kind}, ids array<int>, text string")
