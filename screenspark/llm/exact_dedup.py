"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised texts (A-Z lower-cased, null as
empty), each partition is sorted externally, and neighbours are compared in full:
the rows of a run of equal texts know their best id and their number. A splitter
is short whatever the texts: their first ``HEAD`` characters, a hash that parts
texts with the same beginning, and a slice of the id. The slice cuts a text that a
third of all rows share into ``SLICES`` runs, which may lie in different
partitions. The runs of a text are then summed by the text's SHA-256.

Defined cases: null ids never stay unless a group has no other; rows that repeat
the staying id are all marked as kept, because nothing tells them apart; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.common import lower_ascii, partitions, written

SLICES = 64
HEAD = 32


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the identifier that stays: ``smallest`` or ``largest``.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.pmod(F.xxhash64(id_col), F.lit(SLICES)).alias("slice"),
        lower_ascii(F.col(text_col)).alias("norm"),
    ).withColumns({"head": F.left("norm", F.lit(HEAD)), "mark": F.xxhash64("norm")})
    ranged = rows.repartitionByRange(partitions(spark), "head", "mark", "slice")
    run = Window.partitionBy("head", "mark", "norm", "slice").orderBy("doc_id")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "doc_id",
        "norm",
        best("doc_id").over(whole).alias("run_best"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        F.row_number().over(run).alias("nth"),
    )
    # Written once without the texts: both readers below take it from there.
    runs = written(runs.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "run_best", "run_size", "nth"))
    # Written too: a join of two plain tables can split the rows of a hot text.
    groups = written(
        runs.filter("nth = 1")
        .groupBy("text_sha256")
        .agg(best("run_best").alias("keep_id"), F.sum("run_size").alias("group_size"))
    )
    return runs.join(groups, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
