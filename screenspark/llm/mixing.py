"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source queues its documents in a seeded shuffle, as often as ``max_repeats``
allows. A document copy finishes at the virtual time (source words up to and
including it) / (target of the source): at time 1 every source has given its
target. The copies of all sources are sorted by finish time and taken while the
running total stays within the budget.

Targets: the budget is ``share`` of all words, dealt by weight; no target exceeds
``max_repeats`` times its source's words, and the excess is dealt again by weight
among the rest until none is above.

No window spans a source or the table. Both running totals are two-level: exact
inside ``ranges`` ranges of the sort key, shifted by the totals of the ranges
before. In the shuffle the ranges are leading hash bits. In virtual time they are
equal steps, which carry equal numbers of words because all queues drain at a
constant rate; no sampling is needed. Only the table of sources is ordered as a
whole: one row per source.

Defined cases: sources are ranked by code point with null last; a null or empty
text has size 0 and gives nothing; rows that repeat an id queue one behind the
other, smaller size first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.common import WORD, running_total, written

WEIGHTS, SHARE, MAX_REPEATS, SEED = (3, 1, 2), 1.5, 2, 7
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """One row per source with its size and target.

    With sources in the order of cap per weight, the capped ones come first: a
    source is capped if the level that would serve it and all after it, once all
    before it are capped, lies above its own cap per weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nth", rank)
    cycle = F.lit(list(weights))
    table = named.select(
        "source",
        "source_size",
        "nth",
        F.element_at(cycle, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("weight"),
        (F.col("source_size") * max_repeats).cast("double").alias("cap"),
    )
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * share
    levels = table.select(
        "*",
        budget.alias("budget"),
        ((budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)).alias("level"),
    )
    open_level = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    found = levels.withColumn("final", F.first(open_level, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return found.select("source", "source_size", "nth", "budget", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    ranges: int = RANGES,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, key, source, size, source_size, target, copies, taken``.

    ``key`` is ``key_col`` handed through.

    ``copies`` says how often the mix takes the document, ``taken`` how many words that is.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    sizes = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            digest.alias("place"),
            (F.lit(None).cast("long") if key_col is None else F.col(key_col)).alias("key"),
        )
    )
    targets = written(source_targets(sizes, weights, share, max_repeats))
    queued = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "doc_id",
        "key",
        sizes["source"],
        "nth",
        "size",
        "place",
        "source_size",
        "target",
        "budget",
        (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long").alias("part"),
    )
    # Numbers from here on: rows that repeat an id and a size are the same row to the mix.
    placed = written(running_total(queued, ["nth"], "part", ["place", "doc_id", "size", "key"], "size", "so_far_once"))

    def finish(turn: Column) -> Column:
        return (F.col("so_far_once") + turn * F.col("source_size")) / F.col("target")

    def key(turn: Column) -> Column:
        return F.struct(finish(turn).alias("finish"), "nth", "so_far_once")

    turns = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    queue = (
        placed.filter("size > 0")
        .withColumn("turn", F.explode(turns))
        .select("nth", "so_far_once", "size", "budget", finish(F.col("turn")).alias("finish"))
        .withColumn("step", F.floor(F.col("finish") * ranges))
    )
    ordered = running_total(queue, [], "step", ["finish", "nth", "so_far_once"], "size", "total")
    # The last copy within the budget: one row. A copy is taken if it does not come after it.
    last = ordered.filter(F.col("total") <= F.col("budget")).agg(F.max(F.struct("finish", "nth", "so_far_once"))).scalar()
    copies = F.when(F.col("size") > 0, F.size(F.filter(turns, lambda t: key(t) <= F.col("last")))).otherwise(0)
    return (
        placed.withColumn("last", last)
        .withColumn("copies", F.coalesce(copies, F.lit(0)))
        .select(
            "doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )



def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, rows that are not taken left out."""
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("__key")
    taken = mix(docs.select("*", key), id_col, text_col, source_col, key_col="__key", **options)
    # Rows that repeat all three columns share what the mix takes of them.
    shares = written(taken.groupBy(F.col("key").alias("__k")).agg(F.sum("copies").alias("__all"), F.count("*").alias("__rows")))
    joined = docs.select("*", key).join(shares.filter("__all > 0"), F.col("__key") == F.col("__k"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    own = F.floor((F.col("__all") + F.col("__rows") - nth) / F.col("__rows"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    counted = joined.withColumn("__n", own).filter("__n > 0")
    return counted.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*names)


SQL = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS place FROM documents),
n AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s GROUP BY source),
w AS (
  SELECT *, ({list(WEIGHTS)})[(nth - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight, (source_size * {MAX_REPEATS})::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE AS budget FROM n),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, (cap / weight, nth)) AS final FROM l WHERE level * weight < cap),
t AS (
  SELECT source, nth, source_size, budget, least(cap, coalesce((SELECT final FROM f) * weight, cap)) AS target FROM l),
q AS (
  SELECT s.doc_id, s.size, t.*, sum(size) OVER (PARTITION BY t.nth ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.nth, q.so_far, q.size, q.budget, (q.so_far + r.turn * q.source_size)::DOUBLE / q.target AS finish
  FROM q, range({MAX_REPEATS}) r(turn) WHERE q.size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, nth, so_far ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT nth, so_far, count(*) AS copies FROM o WHERE total <= budget GROUP BY nth, so_far)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(k.copies, 0) * q.size ELSE 0 END AS taken
FROM q LEFT JOIN k ON q.nth = k.nth AND q.so_far = k.so_far AND q.size > 0"""
