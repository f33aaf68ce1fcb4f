"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words by its weight. Documents are counted by source and exact length. Where a
source's target exceeds its size every document is first taken whole as often as it fits; for the rest of the
budget each length is given its proportional share of its documents, what then remains is filled longest first,
and the last words are fitted exactly by a bounded-knapsack dynamic programme over the lengths that are left. That
yields how many documents of each length to take once more; which ones is decided by a seeded hash of doc_id.

Only histograms (a row for each source and length, or for each hash slice of these, of about `SLICE_ROWS` documents) and the
source totals leave the documents. Targets are set on the driver from one row a source, of at most `MAX_SOURCES`; a table of
more ends in an error.

Defined cases: a null text has 0 words; documents of 0 words are taken 0 times. A null source is a source of its own,
after all others. Empty tables give no rows. Rows that agree in source, length and doc_id are told apart by
nothing and may trade places. Reruns agree. Extra columns but the text are kept, those of the result's
names replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, small_side, stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
EXACT = 8192
SLICE_BITS, SLICE_ROWS = 8, 1 << 14
MAX_SOURCES = 1_000_000


def targets(sizes: dict[str | None, int], weights: Iterable[float] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Shares of the sum of `sizes` by weight, none above `most` times its source; the excess goes on by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weights = list(weights)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in set(full)]
    return out


def fit(counts: dict[int, int], budget: int, exact: int = EXACT) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to `budget` or as near below as possible.

    Proportional shares first, the remainder longest first, the last `exact` words by dynamic programming.
    """
    lengths = sorted(x for x in counts if x > 0)
    size = sum(x * counts[x] for x in lengths)
    if budget <= 0 or not size:
        return {}
    if budget >= size:
        return {x: counts[x] for x in lengths}
    taken = {x: counts[x] * budget // size for x in lengths}
    left = budget - sum(x * n for x, n in taken.items())
    at = len(lengths)
    while left > exact and at:
        at = min(at, bisect.bisect_right(lengths, left))
        if not at:
            break
        x = lengths[at - 1]
        n = min(counts[x] - taken[x], max(1, (left - exact) // x), left // x)
        taken[x] += n
        left -= n * x
        at -= 1
    # bounded knapsack: bit s of a state is set where s words can be made; counts in powers of two
    items = []
    for x in lengths:
        n, k = min(counts[x] - taken[x], left // x), 1
        while n > 0:
            items.append((x, min(k, n)))
            n -= k
            k *= 2
    mask, states, reach = (1 << (left + 1)) - 1, [], 1
    for x, k in items:
        states.append(reach)
        reach |= (reach << (x * k)) & mask
        if reach >> left & 1:
            break
    s = reach.bit_length() - 1
    for (x, k), before in zip(reversed(items[: len(states)]), reversed(states), strict=True):
        if not before >> s & 1:
            taken[x] += k
            s -= x * k
    return taken


def mix(documents: DataFrame, weights: Iterable[float] = WEIGHTS, most: int = MOST, seed: str = SEED, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """`documents` without its text, with size, source_size, target and taken (words the mix takes, repeats counted)."""
    spark = documents.sparkSession
    columns = [c for c in documents.columns if c not in (text, "size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own = documents.select(F.struct(*columns).alias("_row"), F.col(source).alias("_source"), size.alias("_size"), F.xxhash64(F.lit(seed), key).alias("_hash"))
    rows = stored(own, "lengths")
    histogram = stored(rows.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "histogram")
    most_alike = histogram.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    rows = rows.withColumn("_slice", F.shiftrightunsigned("_hash", 64 - max(SLICE_BITS, (most_alike // SLICE_ROWS).bit_length())))
    totals = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("s"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: is {source} a source column?")
    sizes = {r["_source"]: int(r["s"]) for r in found}
    goals = targets(sizes, weights, most)
    plan = spark.createDataFrame([(s, n, goals[s], min(most, int(goals[s] // n)) if n else 0) for s, n in sizes.items()], "_of string, source_size long, target double, _whole int")
    plan = small_side(plan, len(sizes), 100_000)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        budget = int(round(row["target"])) - int(row["_whole"]) * int(row["source_size"])
        if row["_whole"] >= most:
            budget = 0
        take = fit(dict(zip(rows["_size"].tolist(), rows["_n"].tolist(), strict=True)), budget)
        return pd.DataFrame({"_key": rows["_source"], "_len": rows["_size"], "_take": rows["_size"].map(lambda x: take.get(x, 0)).astype("int64")})

    # a task sees a source's distinct lengths, never its documents
    taken = histogram.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).groupBy("_source").applyInPandas(choose, "_key string, _len long, _take long")
    taken = stored(taken, "taken")
    # within a length documents are taken in hash order: whole slices, then part of the slice where the count is reached
    slices = rows.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    slices = slices.join(taken, F.col("_source").eqNullSafe(F.col("_key")) & (F.col("_size") == F.col("_len"))).select("_source", "_size", "_slice", F.least("_c", F.greatest(F.lit(0), F.col("_take") - F.col("_before"))).alias("_part"), F.col("_c"))
    quota = slices.where(F.col("_part") > 0).select(F.col("_source").alias("q1"), F.col("_size").alias("q2"), F.col("_slice").alias("q3"), "_part", "_c")
    dealt = rows.join(quota, F.col("_source").eqNullSafe(F.col("q1")) & (F.col("_size") == F.col("q2")) & (F.col("_slice") == F.col("q3")), "left")
    order = Window.partitionBy("_source", "_size", "_slice").orderBy("_hash")
    dealt = dealt.withColumn("_extra", F.coalesce((F.row_number().over(order) <= F.col("_part")).cast("long"), F.lit(0).cast("long")))
    out = dealt.join(plan, F.col("_source").eqNullSafe(F.col("_of")))
    return out.select("_row.*", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("_whole") + F.col("_extra"))).alias("taken"))
