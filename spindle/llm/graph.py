"""Connected components of an edge table, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of each node are tied to the least of them.

    The minimum is aggregated before the join, so a node with very many
    neighbours is no single task's work.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b: long) with the least node reachable.

    Large and small stars by turns, each round cut to the shared folder, until
    a round changes nothing. An edgeless table gives an empty one.
    """
    mark = (F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    at = cut(spark, edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = tuple(at.agg(*mark).head())
    for _ in range(most_rounds):
        before, at = at, cut(spark, _stars(_stars(at, large=True), large=False), "edges")
        discard(before)
        now = tuple(at.agg(*mark).head())
        if now == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"no fixed point within {most_rounds} rounds")
