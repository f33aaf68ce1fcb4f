"""Mates: one-to-one pairing, template-length profiles, library types, profile fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The k-th left row of each key with its k-th right row; right columns get the prefix r_."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = left.withColumn("_k", F.row_number().over(w))
    b = right.withColumn("_k", F.row_number().over(w))
    b = b.select(*keys, "_k", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    return a.join(b, [*keys, "_k"]).drop("_k")


def length_profile(lengths: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total, low, median, high, ave, std): exact marks of a histogram.

    low, median and high are the first lengths at which 0.5 %, 50 % and 99 % of the mass is reached; ave and std are of
    the lengths up to the one that reaches 99.8 %.
    """
    histogram = lengths.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    run = histogram.withColumns({"cum": F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("c").over(w)})
    # whole numbers: 0.5 % is 5 of 1000
    at = lambda mille: F.min(F.when(F.col("cum") * 1000 >= F.col("total") * mille, F.col("v")))
    kept = (F.col("cum") - F.col("c")) * 1000 < F.col("total") * 998
    n, s, q = (F.sum(F.when(kept, x)) for x in (F.col("c"), F.col("c") * F.col("v"), F.col("c") * F.col("v") * F.col("v")))
    sums = run.groupBy(*keys).agg(F.max("total").alias("total"), at(5).alias("low"), at(500).alias("median"), at(990).alias("high"), n.alias("_n"), s.alias("_s"), q.alias("_q"))
    mean = F.col("_s") / F.col("_n")
    return sums.select(*keys, "total", "low", "median", "high", mean.alias("ave"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean)).alias("std"))


def library_type(votes: DataFrame, keys: list[str], first: str, least: int = 100, share: float = 0.8) -> DataFrame:
    """(keys, n, n_first, library): from a boolean column that says which rows speak for FR_FIRST."""
    sums = votes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(first)).alias("n_first"))
    kind = F.when(F.col("n") < least, "UNSTRANDED").when(F.col("n_first") > share * F.col("n"), "FR_FIRST").when(F.col("n") - F.col("n_first") > share * F.col("n"), "FR_SECOND").otherwise("UNSTRANDED")
    return sums.withColumn("library", kind)


def fallback(profiles: DataFrame, evidence: str, least: int, columns: list[str]) -> DataFrame:
    """Profiles with too little evidence copy `columns` from the one with the most (one row, joined to all)."""
    best = profiles.agg(*(F.max_by(c, F.struct(evidence, *columns)).alias(f"_b_{c}") for c in columns))
    return profiles.join(F.broadcast(best)).select(*(F.when(F.col(evidence) < least, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in profiles.columns))
