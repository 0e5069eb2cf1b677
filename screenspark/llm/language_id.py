"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code
point alone. A letter trigram is bound by multiplying the vectors of its letters,
the first rotated twice and the second once, so order matters. A text's profile
bundles (adds) the vectors of its trigrams; a language's prototype bundles all
its training texts. A text gets the language whose prototype has the largest
cosine with its profile, and that cosine as score.

Trigrams are counted first and multiplied with their vectors once per block of
documents. Prototypes are whole-number sums over all training rows, so they do not
depend on any order; they reach the driver as ``DIMENSIONS`` numbers per language.

Letters are Unicode letters, lower-cased; anything between two letters counts as
one gap. Each letter contributes the trigram around it, gaps at both ends of words
included.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is
everything when there are no training rows; rows with a null language are never
learned from; among equal cosines the first language by code point wins; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from screenspark.llm.common import mixed, remainder, written
from screenspark.names import quoted

DIMENSIONS = 1024
BLOCK_CHARS = 1 << 20
BLOCK_CELLS = 6 << 20
BLOCK_GRAMS = 16_384
SLOT_BITS = 22  # the known trigrams are a set of 2 ** 22 hash slots: 512 KB
UNKNOWN = "und"

_LETTER = np.full(0x110000, -1, np.int32)  # lower-cased letter, 0 for others, -1 for not looked up yet
_VECTORS: dict[int, np.ndarray] = {}


def _symbols(codes: np.ndarray) -> np.ndarray:
    found = _LETTER[codes]
    if (found < 0).any():
        for c in np.unique(codes[found < 0]).tolist():
            _LETTER[c] = ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] == "L" else 0
        found = _LETTER[codes]
    return found


def letter_vector(code: int) -> np.ndarray:
    """Signs drawn from the code point; 0 is the gap."""
    if code not in _VECTORS:
        bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _VECTORS[code] = 2 * bits - 1
    return _VECTORS[code]


def trigrams(texts: list[str]):
    """Document, trigram number of every letter; and the letters of each trigram."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    symbols = _symbols(codes)
    owner = np.concatenate(([0], owner))
    stay = symbols != 0
    stay[1:] |= symbols[:-1] != 0
    symbols, owner = symbols[stay], owner[stay]
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int32)
    if symbols[0]:
        symbols, owner = np.append(0, symbols), np.append(0, owner)
    letters, small = np.unique(symbols, return_inverse=True)
    middle = np.flatnonzero(symbols)
    k = len(letters)
    packed = (small[middle - 1] * k + small[middle]) * k + small[middle + 1]
    if k**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(packed, minlength=k**3))
        number = np.empty(k**3, np.int64)
        number[used] = np.arange(len(used))
        which = number[packed]
    else:
        used, which = np.unique(packed, return_inverse=True)
    parts = np.stack([used // (k * k), used // k % k, used % k], axis=1)
    return owner[middle], which, letters[parts]


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    letters, which = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in letters])
    which = which.reshape(grams.shape)
    bound = np.roll(table, 2, axis=1)[which[:, 0]]
    bound *= np.roll(table, 1, axis=1)[which[:, 1]]
    bound *= table[which[:, 2]]
    return bound.astype(np.float32)


def _bundles(counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Rows of counts times the trigrams' vectors, ``BLOCK_GRAMS`` vectors at a time."""
    out = np.zeros((len(counts), DIMENSIONS))
    for a in range(0, len(grams), BLOCK_GRAMS):
        part = slice(a, a + BLOCK_GRAMS)
        out += counts[:, part].astype(np.float32) @ trigram_vectors(grams[part])
    return out


def profiles(texts: list[str]) -> np.ndarray:
    """One bundled vector per text; zero without letters."""
    return _profiles(len(texts), *trigrams(texts))


def _profiles(n_texts: int, owner: np.ndarray, which: np.ndarray, grams: np.ndarray) -> np.ndarray:
    out = np.zeros((n_texts, DIMENSIONS))
    step = max(1, BLOCK_CELLS // max(1, len(grams)))
    for a in range(0, n_texts, step):
        rows = slice(*np.searchsorted(owner, (a, a + step)))
        used, column = np.unique(which[rows], return_inverse=True) if len(grams) > BLOCK_CELLS else (np.arange(len(grams)), which[rows])
        n = min(step, n_texts - a)
        if len(used):
            counts = np.bincount((owner[rows] - a) * len(used) + column, minlength=n * len(used)).reshape(n, -1)
            out[a : a + n] = _bundles(counts, grams[used])
    return out


def _blocks(tables, *columns: str):
    """Rows of limited text, split anywhere between rows."""
    for table in tables:
        rows, size = [], 0
        for row in zip(*(table[c].to_pylist() for c in columns)):
            rows.append(row)
            size += len(row[0] or "") + 64
            if size > BLOCK_CHARS:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


LEARNED = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64())), ("slot", pa.int32()), ("n", pa.int64())])


def _counted(with_slots: bool):
    """Per task the vector sums of every language, and how many documents have a trigram of each slot (2: two or more)."""

    def count(tables):
        sums: dict[str, np.ndarray] = {}
        slots = np.zeros(1 << SLOT_BITS if with_slots else 0, np.uint8)
        for rows in _blocks(tables, "text", "lang"):
            names = sorted({lang for _, lang in rows})
            owner, which, grams = trigrams([t for t, _ in rows])
            if not len(grams):
                continue
            number = np.array([names.index(lang) for _, lang in rows])
            cells = number[owner] * len(grams) + which
            counts = np.bincount(cells, minlength=len(names) * len(grams)).reshape(len(names), -1)
            for a in range(0, len(grams), BLOCK_GRAMS):
                vectors = trigram_vectors(grams[a : a + BLOCK_GRAMS])
                for name, part in zip(names, counts[:, a : a + BLOCK_GRAMS]):
                    whole = np.rint(part.astype(np.float64) @ vectors).astype(np.int64)
                    sums[name] = sums.get(name, 0) + whole
            if with_slots:
                once = np.unique(owner * len(grams) + which) % len(grams)
                used, place = np.unique(trigram_slots(grams), return_inverse=True)
                found = np.bincount(place, np.bincount(once, minlength=len(grams)))
                slots[used] = np.minimum(slots[used] + found, 2)
        names, used = list(sums), np.flatnonzero(slots)
        vectors = pa.array([sums[n].tolist() for n in names], LEARNED.field("v").type)
        yield pa.record_batch([pa.array(names, pa.string()), vectors, pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.int64())], schema=LEARNED)
        nothing = [pa.nulls(len(used), f.type) for f in LEARNED][:2]
        yield pa.record_batch([*nothing, pa.array(used, pa.int32()), pa.array(slots[used], pa.int64())], schema=LEARNED)

    return count


def trigram_slots(grams: np.ndarray) -> np.ndarray:
    """Hash slot of each trigram of three letters."""
    letters = grams.astype(np.uint64)
    packed = (letters[:, 0] << np.uint64(42)) | (letters[:, 1] << np.uint64(21)) | letters[:, 2]
    return (mixed(packed) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def counted(docs: DataFrame, text_col: str, lang_col: str, with_slots: bool) -> DataFrame:
    """What the tasks learn from all rows that have a text and a language, as a written table; see ``_counted``."""
    labelled = docs.select(F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).dropna()
    return written(labelled.mapInArrow(_counted(with_slots), "lang string, v array<long>, slot int, n long"))


def prototypes(learned: DataFrame) -> dict[str, np.ndarray]:
    """Bundled vector of every language: ``DIMENSIONS`` whole numbers each."""
    sums = learned.filter("lang is not null").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["pos"]] = r["v"]
    return out


def known_slots(learned: DataFrame) -> np.ndarray:
    """A flag for every slot of whose trigrams two documents have one: a set of fixed size."""
    counts = learned.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"))
    known = np.zeros(1 << SLOT_BITS, bool)
    known[counts.filter("n > 1").select("slot").toArrow()["slot"].to_numpy()] = True
    return np.packbits(known)


def _scored(n_texts: int, found: tuple, names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    if not names:
        return [UNKNOWN] * n_texts, [0.0] * n_texts
    found = _profiles(n_texts, *found)
    norm = np.sqrt((found**2).sum(axis=1))
    cosine = (found @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
    best = cosine.argmax(axis=1)
    score = np.where(norm > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
    return [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norm)], score.tolist()


def _predicted(model):
    """``row`` with the prediction beside it, and the numbers of its trigrams and of the known ones among them."""

    def predict(tables):
        names, matrix, bits = model.value
        known = np.unpackbits(bits).astype(bool) if bits is not None else None
        for table in tables:
            lang, score, total, hits = [], [], [], []
            for rows in _blocks([table], "text"):
                owner, which, grams = trigrams([t or "" for (t,) in rows])
                found = _scored(len(rows), (owner, which, grams), names, matrix)
                lang += found[0]
                score += found[1]
                if known is not None:
                    hit = known[trigram_slots(grams)][which]
                    total += np.bincount(owner, minlength=len(rows)).tolist()
                    hits += np.bincount(owner[hit], minlength=len(rows)).tolist()
            columns = [table["row"], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if known is not None:
                columns += [pa.array(total, pa.int64()), pa.array(hits, pa.int64())]
            yield pa.record_batch(columns, names=["row", "lang_pred", "score", "trigrams", "known"][: len(columns)])

    return predict


def _predictions(row: Column, docs: DataFrame, text_col: str, learned: DataFrame, with_known: bool) -> DataFrame:
    """``row`` (a struct) of every row of ``docs`` with ``lang_pred, score`` and, if asked for, ``trigrams, known``."""
    found = prototypes(learned)
    names = sorted(found)
    unit = [found[n] / max(np.sqrt((found[n] ** 2).sum()), 1e-9) for n in names]
    known = known_slots(learned) if with_known else None
    model = docs.sparkSession.sparkContext.broadcast((names, np.array(unit), known))
    rows = docs.select(row.alias("row"), F.col(quoted(text_col)).alias("text"))
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    fields += [StructField(c, LongType()) for c in ("trigrams", "known")] if with_known else []
    return rows.mapInArrow(_predicted(model), StructType([rows.schema["row"], *fields]))


def _whole(docs: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[F.col(quoted(c)) for c in names])


def identify(
    docs: DataFrame,
    training: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Learn from the rows where ``training`` holds; one row per input row: the columns ``keep``, ``lang_pred, score``.

    Columns of ``keep`` that are named like the two results are replaced.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    learned = counted(docs.filter(training), text_col, lang_col, with_slots=False)
    found = _predictions(_whole(docs, kept), docs, text_col, learned, with_known=False)
    return found.select(*[F.col(f"row.{quoted(c)}") for c in kept], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


# ---- texts that no learned language explains ------------------------------------------------


def in_known_languages(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that get a language and whose trigrams the labelled rows know.

    A trigram is known if two rows that are learned from have one of its hash slot, so
    that a row does not vouch for itself. The share of known trigrams that a text needs
    is half of what the labelled rows reach but for one in a hundred; a text falls short
    if chance does not explain it (three deviations of so many draws, which short texts
    seldom exceed), or if it knows none. All rows are judged in one pass, whose result
    is written; the share is found in it.
    """
    names = docs.columns
    row = F.struct(_whole(docs, names).alias("all"), (training & F.col(quoted(lang_col)).isNotNull()).alias("labelled"))
    judged = written(_predictions(row, docs, text_col, counted(docs.filter(training), text_col, lang_col, with_slots=True), with_known=True))
    shares = judged.filter("row.labelled AND trigrams > 0").select((F.col("known") / F.col("trigrams")).alias("share"))
    need = (shares.agg(F.percentile_approx("share", 0.01, 10_000)).first()[0] or 0.0) / 2
    n = F.col("trigrams")
    least = n * need - 3 * F.sqrt(n * need * (1 - need))
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") > 0) & (F.col("known") >= least))
    return kept.select(*[F.col(f"row.all.{quoted(c)}") for c in names])
