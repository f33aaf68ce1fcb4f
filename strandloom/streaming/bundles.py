"""Extensions on streams: bundling and depth of reads that arrive in time order. The batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bundles(events: DataFrame, keys: list[str], at: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): rows of a key no further apart than the gap, closed when the watermark passes them."""
    window = F.session_window(at, f"{gap_seconds} seconds")
    grouped = events.withWatermark(at, late).groupBy(*keys, window.alias("_w")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, keys: list[str], at: str, length: str, late: str = "10 minutes") -> DataFrame:
    """(keys, start, n, total): counts and summed values in tumbling windows, late rows within the watermark counted."""
    grouped = events.withWatermark(at, late).groupBy(*keys, F.window(at, length).alias("_w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(*keys, F.col("_w.start").alias("start"), "n", "total")


def new_chains(chains: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """The first of each (chrm, chain) in the stream; repeats within the watermark are dropped."""
    return chains.withWatermark(at, late).dropDuplicatesWithinWatermark(["chrm", "chain"])
