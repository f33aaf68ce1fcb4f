"""Connected components by alternating large-star and small-star rounds, each a join and an aggregation in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stored

ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether each upper end has one edge: with a large-star that changes nothing, all is settled."""
    return edges.agg(F.count_distinct("u")).first()[0] == n


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (u, v): component is the smallest id that can be reached.

    A vertex's neighbours are never gathered: each round takes a minimum by vertex and joins it back, which Spark
    splits where a vertex has very many neighbours. Rounds are written to the shared folder. Their number grows with the
    logarithm of the longest path; after `ROUNDS`, enough for any table, the call ends in an error.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        seen = _signature(now)
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every edge leads down; the smaller ends of each vertex are tied to the smallest of them
        large = stored(large, "large-star")
        if _signature(large) == seen and _stars(large, seen[0]):
            break
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
