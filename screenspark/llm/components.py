"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Written, so that the join that follows sees two plain tables and a hot node can be split."""
    return written(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(links: DataFrame) -> DataFrame:
    """``(a, b)``: each linked node but the smallest of its component, with that smallest node.

    ``links`` has two columns of whole numbers; direction, repeats and self links
    do not matter. Every round is written, so a lost executor costs one round.
    """
    x, y = (F.col(c) for c in links.columns)
    edges = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b")
    edges = written(edges.distinct())
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges).distinct())).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges
