"""Line dedup: suffix array over line ids by prefix doubling; later copies of repeated line runs go.

Every non-blank line gets an id from two 64-bit hashes. A suffix is the sequence
of line ids from a line to the end of its document. Round k knows the rank of
every suffix by its first ``2**k`` lines; the pair (rank here, rank ``2**k`` lines
on) gives the rank by ``2**(k+1)`` lines. Suffixes whose rank is their own are
done and, with documents that hold no open suffix any more, leave the rounds, which
go on until every suffix is alone or has ended: the ranks are then the suffix array.
Equal suffixes that have reached the end of their documents keep one rank.

Suffixes with one rank after ``2**k`` lines are an interval of the suffix array
whose longest common prefix has at least ``2**k`` lines, or all lines that are left.
Of the members of an interval the first in (id, line) order is the original and each
other one a later copy. The largest interval in which a suffix is a later copy says
how many lines from it on are copied; overlapping copies merge into maximal runs,
and these lines go. All runs are judged on the input.

A run counts if it has ``min_lines`` lines, or is one line of ``long_line`` characters,
or is the only line of its document; the last only as a copy of another such document.

Ranks are exact positions: counts per pair, running totals inside slices of a
rank's group, shifted by the slices before. A line that a third of all documents
share is a count per task, then slices; its rows are joined back by a join that
can be split. Every round is written, and deleted when the next one is.

Defined cases: blank lines (white space only) have no id, end no run and always
stay; a null text stays null; an empty text stays empty; rows with equal id and
equal text are one document, so they lose the same lines; a null id comes after
all ids; an empty table gives an empty result; other columns are kept as they are,
but one named ``removed_lines`` is replaced. Rows are told apart by 64-bit hashes of
id and text, lines by 128 bits.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from screenspark.llm.common import running_total, written
from screenspark.names import free_name, quoted
from screenspark.session import discard

MIN_LINES = 2
LONG_LINE = 100
SLICES = 256
END = -1  # the rank past the last line


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, id, line, pos, left, chars, h1, h2)``: ``line`` counts all lines, ``pos`` the non-blank ones.

    ``left`` is the number of non-blank lines from this one on, ``chars`` the line's length.
    """
    split = docs.filter(F.col(text_col).isNotNull()).select(
        _key(id_col, text_col).alias("doc"),
        F.col(id_col).cast("long").alias("id"),
        F.split(text_col, "\n").alias("all"),
    )
    numbered = F.transform("all", lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    full = F.filter(numbered, lambda x: x["text"].rlike(r"[^\x20\x09-\x0D]"))
    rows = split.select("doc", "id", full.alias("full")).select("doc", "id", F.size("full").alias("n"), F.posexplode_outer("full").alias("pos", "x"))
    # The outer form keeps the optimizer from finding the lines of a text twice, once to see that there are any.
    return rows.filter(F.col("pos").isNotNull()).select(
        "doc",
        "id",
        F.col("x.line").alias("line"),
        "pos",
        (F.col("n") - F.col("pos")).alias("left"),
        F.char_length("x.text").alias("chars"),
        F.xxhash64("x.text").alias("h1"),
        F.xxhash64(F.lit(7), "x.text").alias("h2"),
    )


STATE = ["doc", "id", "line", "pos", "left", "rank", "size", "done", "copied"]


def _place() -> Column:
    """Order of (id, line); a null id comes last."""
    return F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("doc"), F.col("pos"))


def _later(first: str) -> Column:
    return (F.col("doc") != F.col(f"{first}.doc")) | (F.col("pos") != F.col(f"{first}.pos"))


def _first_ranks(lines: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    """The state by one line, ids in hash order; ``copied`` is 1 for later copies of lines that count by themselves."""
    only = (F.col("left") == 1) & (F.col("pos") == 0)
    one = F.lit(min_lines <= 1) | (F.col("chars") >= long_line)
    counts = lines.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.when(one, _place())).alias("first"), F.min(F.when(only, _place())).alias("first_only")
    )
    counts = counts.withColumn("part", F.shiftright("h1", 52))  # 4096 even parts
    ranked = written(running_total(written(counts), [], "part", ["h1", "h2"], "size", "upto"))
    ranked = ranked.select("h1", "h2", "size", (F.col("upto") - F.col("size")).alias("rank"), "first", "first_only")
    copied = F.when(one & _later("first") | only & _later("first_only"), 1).otherwise(0)
    state = lines.join(ranked, ["h1", "h2"]).withColumn("copied", copied).withColumn("done", F.lit(False))
    return state.select(*STATE)


def _doubled(state: DataFrame, step: int, total: int, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """The state by ``2 * step`` lines, and the rows that are done: (going on, done)."""
    order = Window.partitionBy("doc").orderBy("pos")
    seen = state.withColumn("next", F.coalesce(F.lead("rank", step).over(order), F.lit(END)))
    seen = written(seen.withColumn("open", (F.col("size") > 1) & ~F.col("done")))
    pairs = seen.filter("open").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"))
    slice_ = F.floor(F.col("next") * SLICES / total)
    counted = written(pairs.withColumn("slice", slice_))
    placed = running_total(counted, ["rank"], "slice", ["next"], "n", "upto")
    fresh = written(
        placed.select(
            F.col("rank").alias("r"), F.col("next").alias("x"), "n", (F.col("rank") + F.col("upto") - F.col("n")).alias("new"), "first"
        )
    )
    # The members of an interval share this many lines.
    shared = F.least(F.col("left"), F.lit(2 * step))
    moved = (
        seen.filter("open")
        .join(fresh, (F.col("rank") == F.col("r")) & (F.col("next") == F.col("x")))
        .withColumn("copied", F.when(_later("first") & (shared >= min_lines), shared).otherwise(F.col("copied")))
        .withColumns({"rank": F.col("new"), "size": F.col("n"), "done": F.col("next") == END})
    )
    every = moved.select(*STATE).unionByName(seen.filter("not open").select(*STATE))
    going = F.max(((F.col("size") > 1) & ~F.col("done")).cast("int")).over(Window.partitionBy("doc"))
    flagged = written(every.withColumn("going", going))
    for table in (seen, counted, fresh):
        discard(table)
    return flagged.filter("going = 1").drop("going"), flagged.filter("going = 0").drop("going")


def _with_windows(state: DataFrame, step: int, min_lines: int) -> DataFrame:
    """``copied`` for runs of just ``min_lines`` lines, no power of two, from the state by ``step`` lines."""
    second = F.lead("rank", min_lines - step).over(Window.partitionBy("doc").orderBy("pos"))
    seen = written(state.withColumn("second", F.when(F.col("left") >= min_lines, second)))
    firsts = seen.filter("second is not null").groupBy("rank", "second").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.filter("n > 1").select(F.col("rank").alias("r"), F.col("second").alias("s"), "first"))
    joined = seen.join(firsts, (F.col("rank") == F.col("r")) & (F.col("second") == F.col("s")), "left")
    copied = F.when(_later("first"), F.greatest("copied", F.lit(min_lines))).otherwise(F.col("copied"))
    return written(joined.withColumn("copied", copied).select(*STATE))


def suffix_ranks(lines: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """``(doc, id, line, pos, left, rank, size, copied)``: every suffix with its place in the suffix array.

    ``size`` suffixes share the rank; ``copied`` is the number of lines from here on
    that are a later copy, 0 for none.
    """
    now = written(_first_ranks(lines, min_lines, long_line))
    total = max(1, now.count())
    finished, step = [], 1
    while True:
        if step < min_lines < 2 * step:
            now = _with_windows(now, step, min_lines)
        now, done = _doubled(now, step, total, min_lines)
        finished.append(done)
        step *= 2
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished).drop("done")


def copied_lines(lines: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """``(doc, gone)``: numbers of the lines that lie in a later copy."""
    suffixes = suffix_ranks(lines, min_lines, long_line)
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.col("pos") + F.col("copied")).over(upto)
    copied = F.max("copied").over(Window.partitionBy("doc"))
    covered = suffixes.withColumn("any", copied).filter(F.col("any") > 0).withColumn("reach", reach).filter(F.col("reach") > F.col("pos"))
    return covered.groupBy("doc").agg(F.collect_list("line").alias("gone"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def kept(t, g):
        if t is None or g is None:
            return t
        out = set(g.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)

    return pd.Series([kept(t, g) for t, g in zip(text, gone)], dtype=object)


def remove_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    long_line: int = LONG_LINE,
    result: str = "removed_lines",
) -> DataFrame:
    """``docs`` with the later copies cut out of the text, and a last column ``result`` (sorted line numbers).

    An input column of that name is replaced.
    """
    gone = copied_lines(written(line_table(docs, id_col, text_col).distinct()), min_lines, long_line)
    own, key, cut = (free_name(docs, n) for n in ("own", "key", "cut"))
    gone = gone.select(F.col("doc").alias(key), F.col("gone").alias(cut))
    names = [c for c in docs.columns if c != result]
    joined = docs.withColumn(own, _key(id_col, text_col)).join(gone, F.col(own) == F.col(key), "left")
    text = _without(F.col(text_col), F.col(cut)).alias(text_col)
    removed = F.sort_array(F.coalesce(cut, F.array().cast("array<int>"))).alias(result)
    return joined.select(*[text if c == text_col else F.col(quoted(c)) for c in names], removed)


SQL = rf"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
  FROM documents),
f AS (
  SELECT doc_id, line, nr, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos, count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after, lead(nr) OVER (PARTITION BY doc_id ORDER BY pos) AS after_nr FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, pos) AS nth FROM w WHERE after IS NOT NULL),
s AS (SELECT doc_id, nr, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM f WHERE length(line) >= {LONG_LINE}),
o AS (SELECT doc_id, nr, row_number() OVER (PARTITION BY line ORDER BY doc_id) AS nth FROM f WHERE n = 1),
g AS (
  SELECT doc_id, nr FROM c WHERE nth > 1 UNION SELECT doc_id, after_nr FROM c WHERE nth > 1
  UNION SELECT doc_id, nr FROM s WHERE nth > 1 UNION SELECT doc_id, nr FROM o WHERE nth > 1),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.nr) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.nr) FILTER (WHERE g.nr IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.nr = g.nr GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""
