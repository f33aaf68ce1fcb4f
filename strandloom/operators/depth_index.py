"""Depth at points and over ranges by running sums: two look-ups a range, whatever lies in it.

Between changes of depth the area up to p is p times the depth so far less the sum of (change times its place), so both
running sums over the changes answer every point; they are carried from bin to bin, and no range meets the pieces in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.carry import BIN, join_on, running


def at_points(pieces: DataFrame, points: DataFrame, keys: list[str], point: str = "p", width: int = BIN) -> DataFrame:
    """(keys, point, depth, area) of the distinct `points`: the depth there and the summed depth before them.

    `pieces` are (keys, start, end, depth); they may overlap, their depths add up.
    """
    changes = pieces.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("p"), F.col("depth").alias("d")), F.struct(F.col("end").alias("p"), (-F.col("depth")).alias("d")))).alias("x"))
    moved = changes.groupBy(*keys, F.col("x.p").alias("_p")).agg(F.sum("x.d").alias("_d")).select(*keys, "_p", "_d", (F.col("_p") * F.col("_d")).alias("_m"), F.lit(0).alias("_asks"))
    asked = points.select(*keys, F.col(point).alias("_p")).distinct().select(*keys, "_p", F.lit(0).cast(dict(moved.dtypes)["_d"]).alias("_d"), F.lit(0).cast(dict(moved.dtypes)["_m"]).alias("_m"), F.lit(1).alias("_asks"))
    rows = moved.unionByName(asked).groupBy(*keys, "_p").agg(F.sum("_d").alias("_d"), F.sum("_m").alias("_m"), F.max("_asks").alias("_asks"))
    summed = running(running(rows, keys, ["_p"], "_d", "depth", "sum", True, width), keys, ["_p"], "_m", "_moment", "sum", True, width)
    return summed.where("_asks = 1").select(*keys, F.col("_p").alias(point), "depth", (F.col("_p") * F.col("depth") - F.col("_moment")).alias("area"))


def over_ranges(pieces: DataFrame, ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """`ranges` with total and mean: summed depth over [start, end), and that over its length (null where it is empty)."""
    ends = ranges.select(*keys, F.explode(F.array(start, end)).alias("p"))
    found = at_points(pieces, ends, keys, "p", width).select(*keys, "p", "area")
    met = ranges
    for c, name in ((start, "_before"), (end, "_upto")):
        met = join_on(met, found.select(*keys, F.col("p").alias(c), F.col("area").alias(name)), [*keys, c], "left")
    total = F.col("_upto") - F.col("_before")
    return met.select(*ranges.columns, total.alias("total"), F.when(F.col(end) > F.col(start), total / (F.col(end) - F.col(start))).alias("mean"))
