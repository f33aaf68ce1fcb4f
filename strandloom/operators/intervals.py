"""Interval operators: islands, depth, rectangles, point and overlap joins.

Intervals are half-open. Everything ordered is cut into bins of positions first: order-dependent work runs within a
bin, and only a summary of each bin is ordered over a whole key, so a key with most of the rows is spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import carry
from strandloom.operators.carry import BIN


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _numbered(df: DataFrame, parts: list[str], start: str, end: str, gap: int, name: str) -> DataFrame:
    """`name`: 0, 1, ... within `parts` (bins), one more where a start lies beyond the furthest end so far by more than gap."""
    order = Window.partitionBy(*parts).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > reach + gap).cast("int"), F.lit(0)))
    return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def _islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, width: int) -> tuple[DataFrame, DataFrame]:
    local = _numbered(df.withColumn("_bin", _bin(F.col(start), width)), [*keys, "_bin"], start, end, gap, "_local")
    parts = local.groupBy(*keys, "_bin", "_local").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.count("*").alias("_n"))
    # a bin's own islands lie apart: one is new unless what earlier bins reach to comes near it, and those that are not new come first
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.groupBy(*keys, "_bin").agg(F.max("_e").alias("_far")).select(*keys, "_bin", F.max("_far").over(by_bin).alias("_reach"))
    told = carry.join_on(parts, reach, [*keys, "_bin"]).withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap), F.col("_s"))).drop("_reach")
    last = told.groupBy(*keys, "_bin").agg(F.max("_fresh").alias("_last")).select(*keys, "_bin", F.max("_last").over(by_bin).alias("_begun"))
    named = carry.join_on(told, last, [*keys, "_bin"])
    return local, named.select(*parts.columns, F.coalesce("_fresh", "_begun").alias("_island"))


def merge_islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, width: int = BIN) -> DataFrame:
    """(keys, start, end, n): unions of intervals no further apart than `gap`."""
    _, parts = _islands(df, keys, start, end, gap, width)
    return parts.groupBy(*keys, F.col("_island").alias("start")).agg(F.max("_e").alias("end"), F.sum("_n").alias("n"))


def assign_islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, width: int = BIN) -> DataFrame:
    """`df` with island_start and island_end of the island each row lies in."""
    local, parts = _islands(df, keys, start, end, gap, width)
    whole = parts.groupBy(*keys, "_island").agg(F.max("_e").alias("island_end"))
    names = carry.join_on(parts.select(*keys, "_bin", "_local", "_island"), whole, [*keys, "_island"]).withColumnRenamed("_island", "island_start")
    return carry.join_on(local, names, [*keys, "_bin", "_local"]).drop("_bin", "_local")


def depth(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", weight: str | None = None, width: int = BIN) -> DataFrame:
    """(keys, start, end, depth): maximal pieces of equal, non-zero summed weight, by a sweep over summed changes."""
    w = F.lit(1) if weight is None else F.col(weight)
    changes = df.where(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("p"), w.alias("w")), F.struct(F.col(end).alias("p"), (-w).alias("w")))).alias("_c"))
    points = changes.groupBy(*keys, F.col("_c.p").alias("_p")).agg(F.sum("_c.w").alias("_w")).where("_w <> 0").withColumn("_bin", _bin(F.col("_p"), width))
    totals = points.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_t"), F.min("_p").alias("_first"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    totals = totals.select(*keys, "_bin", F.coalesce(F.sum("_t").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(by_bin).alias("_following"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_p")
    swept = points.join(totals, [*keys, "_bin"]).select(*keys, F.col("_p").alias("start"), F.coalesce(F.lead("_p").over(inside), "_following").alias("end"), (F.col("_before") + F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("depth"))
    return swept.where("depth <> 0")


def rectangles(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covered, area, max_depth, mean_depth, dev_depth): length-weighted over pieces (start, end, depth)."""
    length = F.col("end") - F.col("start")
    sums = pieces.groupBy(*keys).agg(
        F.sum(length).cast("long").alias("covered"), F.sum(length * F.col("depth")).cast("long").alias("area"),
        F.sum(length * F.col("depth") * F.col("depth")).cast("long").alias("_square"), F.max("depth").alias("max_depth"),
    )
    mean = F.col("area") / F.col("covered")
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("_square") / F.col("covered") - mean * mean))
    return sums.select(*keys, "covered", "area", "max_depth", mean.alias("mean_depth"), dev.alias("dev_depth"))


def triangles(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slope, intercept): least squares of depth on each piece's midpoint, every piece alike."""
    middle = (F.col("start") + F.col("end")) / 2
    return pieces.groupBy(*keys).agg(F.regr_slope("depth", middle).alias("slope"), F.regr_intercept("depth", middle).alias("intercept"))


def binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """`df` once for each bin that the interval [start, end) touches."""
    last = F.greatest(_bin(F.col(start), width), _bin(F.col(end) - 1, width))
    return df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), last)))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Each point with every interval of its keys that contains it, by an equi-join on bins."""
    placed = points.withColumn("_bin", _bin(F.col(point), width))
    met = placed.join(binned(intervals, start, end, width), [*keys, "_bin"])
    return met.where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) that overlap, each once, with the overlap's length."""
    a, b = binned(left, "start", "end", width), binned(right, "r_start", "r_end", width)
    met = a.join(b, [*keys, "_bin"])
    first = F.greatest("start", "r_start")
    shared = F.least("end", "r_end") - first
    return met.where((shared > 0) & (F.col("_bin") == _bin(first, width))).withColumn("overlap", shared).drop("_bin")


def without_contained(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Distinct intervals that lie in no other interval of their keys."""
    own = df.select(*keys, start, end).distinct()
    # within a bin: something that starts earlier, or as early and ends later, reaches as far
    order = Window.partitionBy(*keys, "_bin").orderBy(F.asc(start), F.desc(end))
    cut = own.withColumn("_bin", _bin(F.col(start), width))
    reach = cut.groupBy(*keys, "_bin").agg(F.max(end).alias("_e"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(*keys, "_bin", F.max("_e").over(by_bin).alias("_earlier"))
    seen = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_earlier"))
    marked = cut.join(reach, [*keys, "_bin"]).withColumn("_seen", seen)
    return marked.where(F.col("_seen").isNull() | (F.col("_seen") < F.col(end))).select(*keys, start, end)


def segments(points: DataFrame, keys: list[str], point: str = "p", width: int = BIN) -> DataFrame:
    """(keys, start, end): consecutive distinct breakpoints."""
    own = points.select(*keys, F.col(point).alias("start")).distinct()
    return carry.following(own, keys, ["start"], {"start": "end"}, width).where("end is not null")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tolerance: int, id_: str, width: int | None = None) -> DataFrame:
    """Each left row with the latest right_at <= at of its keys within `tolerance`: an equi-join on tolerance-wide bins."""
    width = width or max(1, tolerance)
    a = left.withColumn("_bin", F.explode(F.array(_bin(F.col(at), width), _bin(F.col(at), width) - 1)))
    b = right.groupBy(*keys, F.col(right_at)).agg(F.count("*").alias("_c")).withColumn("_bin", _bin(F.col(right_at), width))
    met = a.join(b, [*keys, "_bin"]).where((F.col(right_at) <= F.col(at)) & (F.col(at) - F.col(right_at) <= tolerance))
    return met.groupBy(*keys, id_, at).agg(F.max(right_at).alias(right_at))
