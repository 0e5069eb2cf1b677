"""Quality rules: statistics of every text, base rules, and an isolation forest over the statistics.

Every text gives counts of words, characters, symbols, equal lines and repeated
3-word windows. Two base rules on them drop a document outright. For the others an
isolation forest decides: trees of random splits over shares of these counts isolate an
unusual document after few splits, so a short mean path length marks an anomaly. The
score from which a document is dropped is calibrated on the labelled rows that pass the
base rules: of all cuts that cost at most ``MAX_LOSS`` of the good ones, the one that
catches most of the bad ones beyond what it costs.

The forest is grown on a bounded sample of those labelled rows, whatever their labels:
the ``SAMPLE`` ones with the smallest row hashes. Each of ``TREES`` trees draws ``PSI``
of them and is grown in a Spark task. The trees have at most ``2 * PSI`` nodes each and
are broadcast; calibration counts all labelled rows in ``BINS`` bins of the score, and
all documents are scored.

Defined cases: a null or empty text has no word, so it fails the base rules; rows are
judged one by one, so repeated rows and ids stay and get equal results; equal labels
of one id count as often as its rows meet; labels with null id or null quality do not
count; without labelled rows every score is 0; without bad ones only the base rules
drop documents; without good ones any cut costs nothing; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.byte_words import row_blocks
from screenspark.llm.common import mixed, word_hashes, written

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
TREES, PSI, SAMPLE = 100, 256, 8192
BINS, MAX_LOSS = 4096, 0.03
SEED = 42
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_lower", "n_digits", "n_marks", "n_distinct_words"]
FEATURES = ["word_length", "symbols_per_word", "upper_share", "digit_share", "mark_share", "distinct_word_share"]
EULER = 0.5772156649015329


def _byte_kinds() -> np.ndarray:
    """Kind of every byte: a later byte of a character, white space, upper, lower, digit, symbol, other mark, other."""
    kind = np.full(256, 7, np.uint8)
    kind[0x80:0xC0] = 0
    kind[[0x20, *range(0x09, 0x0E)]] = 1
    kind[ord("A") : ord("Z") + 1], kind[ord("a") : ord("z") + 1], kind[ord("0") : ord("9") + 1] = 2, 3, 4
    kind[list(SYMBOLS)] = 5
    kind[[b for b in range(0x21, 0x7F) if kind[b] == 7]] = 6
    return kind


KINDS = _byte_kinds()


def _kind_counts(texts: list[bytes]) -> np.ndarray:
    """Bytes of each kind in every text: one row per text."""
    kinds = KINDS[np.frombuffer(b"".join(texts), np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    out = np.zeros((len(texts), 8), np.int64)
    for k in range(8):
        upto = np.concatenate(([0], np.cumsum(kinds == k)))[ends]
        out[:, k] = np.diff(upto, prepend=0)
    return out


def _repeats(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, distinct words, and words in 3-word windows found twice or more, of every text."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(texts)), lengths)
    hashes = word_hashes([w for each in words for w in each])
    salted = hashes ^ mixed(owner + 1)  # equal words of two texts differ
    once, place = np.unique(salted, return_index=True)
    distinct = np.bincount(owner[place], minlength=len(texts))
    covered = np.zeros(len(owner), bool)
    if len(owner) > 2:
        inside = owner[2:] == owner[:-2]
        windows = mixed(mixed(mixed(salted[:-2]) ^ hashes[1:-1]) ^ hashes[2:])[inside]
        begins = np.flatnonzero(inside)
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        again = np.zeros(len(begins), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for i in range(3):
            covered[begins[again] + i] = True
    return lengths, distinct, np.bincount(owner[covered], minlength=len(texts))


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full) - len(set(full))


def _measured(tables):
    for block in row_blocks(tables, "text"):
        texts = block["text"].to_pylist()
        kinds = _kind_counts(texts)
        n_words, distinct, repeated = _repeats(texts)
        chars, symbols, lines = kinds[:, 2:].sum(axis=1), kinds[:, 5], [_repeated_lines(t) for t in texts]
        columns = [n_words, chars, symbols, lines, repeated, kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 6], distinct]
        yield pa.record_batch([block["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS, *MORE])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts ``COUNTS`` and ``MORE`` of every row's whole text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTS, *MORE]))


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature_matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as shares and logarithms: one row per document."""
    c = {k: np.asarray(v, np.float64) for k, v in columns.items()}

    def share(part, whole):
        return part / np.maximum(whole, 1)

    return np.stack(
        [
            share(c["word_chars"], c["n_words"]),
            share(c["n_symbols"], c["n_words"]),
            share(c["n_upper"], c["n_upper"] + c["n_lower"]),
            share(c["n_digits"], c["word_chars"]),
            share(c["n_marks"], c["word_chars"]),
            share(c["n_distinct_words"], c["n_words"]),
        ],
        axis=1,
    )


# ---- isolation forest -----------------------------------------------------------------------


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows: what a leaf of ``n`` rows still stands for."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def grown_tree(rows: np.ndarray, pick: np.random.Generator, limit: int) -> list[tuple[int, float, int, float]]:
    """Nodes ``(feature, cut, left child, path length)``; feature -1 is a leaf; the right child follows the left one."""
    nodes: list[tuple[int, float, int, float]] = [(-1, 0.0, 0, 0.0)]
    todo = [(0, rows, 0)]
    while todo:
        at, part, depth = todo.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth >= limit or not len(open_):
            nodes[at] = (-1, 0.0, 0, depth + mean_path(len(part)))
            continue
        feature = int(pick.choice(open_))
        cut = float(pick.uniform(low[feature], high[feature]))
        left = part[:, feature] <= cut
        nodes[at] = (feature, cut, len(nodes), 0.0)
        todo += [(len(nodes), part[left], depth + 1), (len(nodes) + 1, part[~left], depth + 1)]
        nodes += [(-1, 0.0, 0, 0.0)] * 2
    return nodes


def forest_scores(trees: list[np.ndarray], rows: np.ndarray, psi: int) -> np.ndarray:
    """2 ** -(mean path length / mean path length of ``psi`` rows): near 1 for anomalies, 0 without trees."""
    if not trees or psi < 2:
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for nodes in trees:
        feature, cut, child, path = nodes[:, 0].astype(np.int64), nodes[:, 1], nodes[:, 2].astype(np.int64), nodes[:, 3]
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            right = rows[every, feature[at]] > cut[at]
            at = np.where(inner, child[at] + right, at)
        total += path[at]
    return 2.0 ** -(total / len(trees) / mean_path(psi))


def _grown(sample, trees_psi):
    def grow(tables):
        rows, psi = sample.value, trees_psi
        for table in tables:
            for tree in table["id"].to_pylist():
                pick = np.random.Generator(np.random.Philox(key=[SEED, tree]))
                drawn = rows[pick.choice(len(rows), psi, replace=False)]
                nodes = grown_tree(drawn, pick, math.ceil(math.log2(max(2, psi))))
                f, c, l, p = zip(*nodes)
                lists = [pa.array([list(map(float, x))], pa.list_(pa.float64())) for x in (f, c, l, p)]
                yield pa.record_batch([pa.array([tree], pa.int64()), *lists], names=["tree", "feature", "cut", "child", "path"])

    return grow


def forest(known: DataFrame, trees: int = TREES, psi: int = PSI, sample: int = SAMPLE) -> tuple[list[np.ndarray], int]:
    """Trees grown on ``sample`` rows of ``known`` at most, and how many rows each of them drew."""
    spark = known.sparkSession
    names = [*COUNTS, *MORE]
    few = known.select(*names).orderBy(F.xxhash64(F.lit(SEED), "doc_id", *names), *names).limit(sample).toArrow()
    rows = feature_matrix({c: few[c].to_numpy() for c in names})
    if not len(rows):
        return [], 0
    psi = min(psi, len(rows))
    held = spark.sparkContext.broadcast(rows)
    schema = "tree long, feature array<double>, cut array<double>, child array<double>, path array<double>"
    found = spark.range(trees).mapInArrow(_grown(held, psi), schema).toArrow().sort_by("tree")  # 2 * psi nodes a tree
    parts = [found[c].to_pylist() for c in ("feature", "cut", "child", "path")]
    return [np.stack([np.array(x) for x in tree], axis=1) for tree in zip(*parts)], psi


def with_scores(stats: DataFrame, trees: list[np.ndarray], psi: int) -> DataFrame:
    """``stats`` with the anomaly score as a last column ``score``."""
    model = stats.sparkSession.sparkContext.broadcast(trees)
    names = [*COUNTS, *MORE]

    def score(tables):
        for table in tables:
            rows = feature_matrix({c: table[c].to_numpy() for c in names})
            found = forest_scores(model.value, rows, psi)
            yield pa.record_batch([*table.columns, pa.array(found)], names=[*table.schema.names, "score"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in stats.dtypes)
    return stats.mapInArrow(score, f"{fields}, score double")


def threshold(labelled: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The score from which rows are dropped: an edge of a bin, above 1 to drop none.

    Of the edges that cost at most ``max_loss`` of the good rows, the one with the
    largest share of bad rows less share of good rows; the highest of equal ones.
    """
    bins = labelled.filter("quality IN (0, 1)").groupBy("quality", F.floor(F.col("score") * BINS).alias("bin")).count().collect()
    counts = np.zeros((2, BINS + 2), np.int64)
    for r in bins:
        counts[r["quality"], r["bin"]] = r["count"]
    from_here = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at or above each edge
    lost, caught = (from_here[q] / max(1, from_here[q, 0]) for q in (1, 0))
    gain = np.where(lost <= max_loss, caught - lost, -1.0)
    return int(len(gain) - 1 - gain[::-1].argmax()) / BINS


def judged_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    max_loss: float = MAX_LOSS,
) -> DataFrame:
    """Per document ``doc_id``, its statistics, ``base_failed``, ``score`` and ``kept``.

    ``label_col`` is 1 for good and 0 for bad rows; ``labels`` names some of the documents.
    """
    stats = written(statistics(docs, id_col, text_col))
    named = labels.select(F.col(label_id).cast("long").alias("labelled"), F.col(label_col).cast("int").alias("quality")).dropna()
    known = written(stats.filter(~base_failed()).join(named, F.col("doc_id") == F.col("labelled")).drop("labelled"))
    trees, psi = forest(known)
    limit = threshold(with_scores(known, trees, psi), max_loss)
    scored = with_scores(stats, trees, psi)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


# The counts of every document; the forest's verdict cannot be said in SQL.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT row_no, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
t AS (SELECT row_no, unnest(range(1, len(words) - 1)) AS i, words FROM w),
g AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, words[i], words[i + 1], words[i + 2]) AS n FROM t),
r AS (SELECT row_no, count(DISTINCT i + k) AS repeated FROM g, range(3) x(k) WHERE n > 1 GROUP BY row_no)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
       coalesce(repeated, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN u USING (row_no) LEFT JOIN r USING (row_no)"""
