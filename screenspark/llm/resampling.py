"""Target-distribution importance resampling with hashed n-grams.

Words come from bytes: a 256-byte table lower-cases and blanks separators in UTF-8 and
``bytes.split`` yields the words (``byte_words``). ``zlib.crc32`` of a word is the
seed of the crc32 of the next one, so runs of one, two and three words cost one call
each; a run's bucket is its crc32 modulo ``buckets``. Counters of every task are
reduced by Spark to one count per bucket, for the raw documents and for the target
texts. The gain of a bucket is the logarithm of its smoothed share in the target over
that in the raw documents; the weight of a document is the sum of its features' gains.

Documents are drawn without replacement by the Gumbel top-k rule: every document's
weight gets a Gumbel number drawn from its id, and the highest sums are drawn. The
order is exact at every size: documents that may be drawn fall into ranges between
sampled scores and are ranked inside their range.

Only the counts of the buckets (a fixed number) reach the driver and are broadcast.

Defined cases: a null or empty text has no feature, weight 0 and is never drawn; a
null id draws its Gumbel number from the empty id and ranks behind equal scores; rows
that repeat an id are documents of their own, equal scores and ids by number of
features and weight; an empty table gives an empty result; without target texts or without documents
all counts of that side are 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.byte_words import row_blocks, word_slices
from screenspark.llm.common import partitions, running_total, written

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
RANGE_ACCURACY = 10_000


def feature_codes(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of every run that ends in these words) for each slice of a text."""
    open_runs: list[list[int]] = [[] for _ in range(longest - 1)]  # of 1, 2, .. words, ending at the last word seen
    for words in word_slices(text):
        codes = list(map(zlib.crc32, words))
        spaced = [b" " + w for w in words]
        runs, found = codes, [codes]
        for tail in open_runs:
            # A run of k + 1 words ends where one of k words ended one word before.
            longer = list(map(zlib.crc32, spaced[len(spaced) - len(runs) + (not tail) :], itertools.chain(tail, runs)))
            tail[:] = runs[-1:] or tail
            runs = longer
            found.append(runs)
        yield len(words), list(itertools.chain.from_iterable(found))


def _counted(buckets: int, longest: int):
    def count(tables):
        total: Counter[int] = Counter()
        for block in row_blocks(tables, "text"):
            for text in block["text"].to_pylist():
                for _, codes in feature_codes(text, longest):
                    total.update((np.array(codes, np.int64) % buckets).tolist())
        keys = sorted(total)
        yield pa.record_batch({"bucket": pa.array(keys, pa.int32()), "n": pa.array([total[k] for k in keys], pa.int64())})

    return count


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences of the features of all texts in each bucket."""
    parts = texts.select(_bytes(F.col(text_col))).mapInArrow(_counted(buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down."""
    n = len(raw)
    all_raw, all_target = float(raw.sum() + n), float(target.sum() + n)
    share = [float(t + 1) * all_raw / (float(s + 1) * all_target) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def _weighed(model, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(tables):
        gains = model.value
        for block in row_blocks(tables, "text"):
            rows = []
            for text in block["text"].to_pylist():
                n_words = n_features = weight = 0
                for n, codes in feature_codes(text, longest):
                    n_words += n
                    n_features += len(codes)
                    weight += int(gains[np.array(codes, np.int64) % len(gains)].sum())
                rows.append((n_words, n_features, weight))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.record_batch([block["doc_id"], *columns], schema=schema)

    return weigh


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, rounded down, that the id and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed_documents(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """Per document ``doc_id, n_words, n_features, weight, score``; learns the gains from all rows of both tables."""
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    model = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bytes(F.col(text_col)))
    found = rows.mapInArrow(_weighed(model, longest), "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def drawn(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: ranks of the drawn documents, null for all others.

    ``percent`` of the documents with ``least_words`` words are drawn, rounded down.
    """
    rows = written(weighed)
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    wanted = percent * n // 100
    cuts = _cuts(able, percent / 100, max(64, 4 * partitions(rows.sparkSession)))
    names = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cuts[0])
    # Range 0 holds the highest scores.
    place = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c > F.col("score")))
    ties = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    one = rows.filter(high).withColumn("range", place).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(one, [], "range", ties, "one", "rank")
    rank = F.when(F.col("rank") <= wanted, F.col("rank"))
    rest = rows.filter(~high).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank.alias("rank")).unionByName(rest)


def _cuts(rows: DataFrame, share: float, ranges: int) -> list[int]:
    """Ascending scores, of which the least is reached by at least ``share`` of the rows.

    They split that share into ranges of about one size, whose rows are ranked
    together. Sampled percentiles are off by one in ``RANGE_ACCURACY`` rows at most.
    """
    reach = share + 2 / RANGE_ACCURACY
    shares = [max(0.0, 1 - reach * i / ranges) for i in range(1, ranges + 1)]
    found, least = rows.agg(F.percentile_approx("score", shares, RANGE_ACCURACY), F.min("score")).first()
    return sorted({*(found or []), *([least] if reach >= 1 and found else [])})


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; those with a rank are the sample, best first."""
    return drawn(weighed_documents(docs, target, **options), percent, least_words)
