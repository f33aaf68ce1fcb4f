"""Chains of positions: counting, junctions, supports, similarity of bundles, and grouping under a size limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.arrays import introns, pairs
from strandloom.operators.components import components
from strandloom.operators.carry import BIN
from strandloom.operators.intervals import _bin


def chain_counts(reads: DataFrame, keys: list[str], chain: str = "chain", tag: str = "xs") -> DataFrame:
    """(keys, chain, c0, c1, c2): how often each chain occurs without a tag, with + and with -."""
    by = lambda v: F.count_if(F.col(tag).eqNullSafe(F.lit(v)))
    return reads.groupBy(*keys, chain).agg(by(None).alias("c0"), by("+").alias("c1"), by("-").alias("c2"))


def merge_counts(*parts: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """Sums of several chain counts; a part with negative counts takes chains away."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys, chain).agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "c2"))).where("c0 + c1 + c2 > 0")


def splice_positions(chains: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """(keys, p): distinct positions."""
    return chains.select(*keys, F.explode(chain).alias("p")).distinct()


def junctions(chains: DataFrame, keys: list[str], least: int = 1, chain: str = "chain") -> DataFrame:
    """(keys, l, r, count, strand) of introns with at least `least` reads; strand by the larger tagged count."""
    rows = chains.where(F.size(chain) > 1).select(*keys, "c0", "c1", "c2", F.explode(introns(F.col(chain))).alias("j"))
    sums = rows.groupBy(*keys, F.col("j.l").alias("l"), F.col("j.r").alias("r")).agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "c2")))
    strand = F.when(F.col("c1") > F.col("c2"), "+").when(F.col("c1") < F.col("c2"), "-").otherwise(".")
    return sums.withColumn("count", F.col("c0") + F.col("c1") + F.col("c2")).where(F.col("count") >= least).select(*keys, "l", "r", "count", strand.alias("strand"))


def neighbour_counts(chains: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """(keys, l, r, count): neighbours in chains, counted."""
    return chains.select(*keys, F.explode(pairs(F.col(chain))).alias("j")).groupBy(*keys, F.col("j.l").alias("l"), F.col("j.r").alias("r")).agg(F.count("*").alias("count"))


def near_opposite(rows: DataFrame, keys: list[str], l: str, r: str, strand: str, distance: int) -> DataFrame:  # noqa: E741
    """Distinct (keys, l1, r1, l2, r2): a + and a - junction within L1 `distance`, met in bins of l."""
    own = rows.select(*keys, F.col(l).alias("l"), F.col(r).alias("r"), F.col(strand).alias("s")).distinct()
    width = max(1, distance)
    plus = own.where("s = '+'").select(*keys, F.col("l").alias("l1"), F.col("r").alias("r1"), F.explode(F.array(*(_bin(F.col("l"), width) + k for k in (-1, 0, 1)))).alias("_bin"))
    minus = own.where("s = '-'").select(*keys, F.col("l").alias("l2"), F.col("r").alias("r2"), _bin(F.col("l"), width).alias("_bin"))
    met = plus.join(minus, [*keys, "_bin"]).drop("_bin")
    return met.where(F.abs(F.col("l1") - F.col("l2")) + F.abs(F.col("r1") - F.col("r2")) <= distance)


def similar_bundles(positions: DataFrame, least: float, most_positions: int, bundle: str = "bundle", p: str = "p") -> DataFrame:
    """`similar_sets` of the distinct positions of each bundle."""
    own = positions.select(F.col(bundle).alias("b"), F.col(p).alias("p")).where("p is not null")
    return similar_sets(own.groupBy("b").agg(F.collect_set("p").alias("set")), least, most_positions, "b", "set")


def similar_sets(sets: DataFrame, least: float, most_positions: int, bundle: str = "bundle", of: str = "chain") -> DataFrame:
    """(i, j, common, ratio) for i < j: shared positions over the smaller set, at least `least`. `sets` has one row of distinct positions a bundle.

    Enough shared positions must touch the rarest few of the smaller set, so only those look for partners; each pair found is
    then counted on the whole sets. Bundles of more than `most_positions` are not compared, but their positions count as often as they occur.
    """
    every = sets.select(F.col(bundle).alias("b"), F.col(of).alias("_set"))
    often = every.select(F.explode("_set").alias("p")).groupBy("p").agg(F.count("*").alias("_often"))
    whole = every.where(F.size("_set").between(1, most_positions))
    ranked = whole.select("b", F.explode("_set").alias("p")).join(often, "p").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("_often", "p"))).alias("_r"))  # at most `most_positions` each
    n = F.size("_r")
    need = F.ceil(n * F.lit(float(least)) - F.lit(1e-9))
    rare = F.slice("_r", F.lit(1), (n - F.greatest(need, F.lit(1)) + 1).cast("int"))
    asks = ranked.select(F.col("b").alias("a"), n.alias("na"), F.explode(rare["p"]).alias("p"))
    held = ranked.select(F.col("b").alias("c"), n.alias("nc"), F.explode(F.col("_r")["p"]).alias("p"))
    larger = (F.col("na") < F.col("nc")) | ((F.col("na") == F.col("nc")) & (F.col("a") < F.col("c")))
    # dealt by a, a pair's repeats meet and its first set is at hand
    met = asks.join(held, "p").where(larger).select("a", "c").repartition("a").dropDuplicates(["a", "c"])
    both = met.join(whole.select(F.col("b").alias("a"), F.col("_set").alias("_x")), "a").join(whole.select(F.col("b").alias("c"), F.col("_set").alias("_y")), "c")
    common = F.size(F.array_intersect("_x", "_y")).cast("long")
    found = both.select(F.least("a", "c").alias("i"), F.greatest("a", "c").alias("j"), common.alias("common"), (common / F.least(F.size("_x"), F.size("_y"))).alias("ratio"))
    return found.where(F.col("ratio") >= least)


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def capped_groups(similar: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, member, root): unions in descending ratio (ties by i, j) while both sides are smaller than `limit`.

    The order of unions matters, so each key's pairs are one task; keys are regions of one strand.
    """
    schema = similar.select(*keys, F.col("i").alias("member"), F.col("i").alias("root")).schema

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}
        size: dict = {}

        def find(x):
            up.setdefault(x, x)
            size.setdefault(x, 1)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j in rows.sort_values(["ratio", "i", "j"], ascending=[False, True, True])[["i", "j"]].itertuples(index=False):
            a, b = find(i), find(j)
            if a != b and size[a] < limit and size[b] < limit:
                a, b = min(a, b), max(a, b)
                up[b] = a
                size[a] += size[b]
        out = pd.DataFrame({"member": list(up), "root": [find(x) for x in list(up)]})
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "member", "root"]]

    return similar.groupBy(*keys).applyInPandas(union, schema)


def bundle_groups(similar: DataFrame, limit: int) -> DataFrame:
    """(member, root) as `capped_groups` over all pairs (i, j, ratio): what is not connected cannot unite, so a component is a task."""
    found = components(similar.select(F.col("i").alias("u"), F.col("j").alias("v"))).withColumnRenamed("id", "i")
    return capped_groups(similar.join(found, "i"), ["component"], limit).select("member", "root")


def gap_clusters(rows: DataFrame, keys: list[str], bounds: list[str], gap: int, width: int = BIN) -> DataFrame:
    """`rows` with cluster: split by each bound in turn wherever it jumps by more than `gap` within the cluster so far."""
    jump = lambda here, before: F.coalesce((here - before > gap).cast("long"), F.lit(0).cast("long"))
    parts, columns = list(keys), list(rows.columns)
    for k, c in enumerate(bounds):
        # a bin has a name without nulls, so that rows are dealt and sorted once, and what earlier bins came to meets them where they are
        place = F.struct(*(F.col(x).alias(f"k{i}") for i, x in enumerate(parts)), _bin(F.col(c), width).alias("bin"))
        cut = rows.withColumn("_place", place).withColumn("_hash", F.xxhash64("_place")).drop(*parts)
        inside = Window.partitionBy("_hash", "_place").orderBy(c)
        local = cut.withColumn("_new", jump(F.col(c), F.lag(c).over(inside))).withColumn("_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
        ends = local.groupBy("_hash", "_place").agg(F.min(c).alias("_first"), F.max(c).alias("_last"), F.max("_local").alias("_inner"))
        by_bin = Window.partitionBy(*(F.col(f"_place.k{i}") for i in range(len(parts)))).orderBy("_place.bin")
        opened = ends.withColumn("_open", jump(F.col("_first"), F.lag("_last").over(by_bin)))
        earlier = F.sum(F.col("_open") + F.col("_inner")).over(by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_inner")
        given = opened.select("_hash", "_place", earlier.alias("_earlier")).where("_earlier <> 0")
        told = local.join(given, ["_hash", "_place"], "left")
        own = {x: F.col(f"_place.k{i}") for i, x in enumerate(parts)}
        columns.append(f"_c{k}")
        rows = told.withColumn(f"_c{k}", F.col("_local") + F.coalesce("_earlier", F.lit(0).cast("long"))).select(*(own[x].alias(x) if x in own else F.col(x) for x in columns))
        parts.append(f"_c{k}")
    names = [f"_c{k}" for k in range(len(bounds))]
    return rows.withColumn("cluster", F.concat_ws(".", *names)).drop(*names)


def support(edges: DataFrame, evidence: DataFrame, on: list[str], sample: str, amount: str) -> DataFrame:
    """`edges` with n_samples, samples and total abundance of the evidence on the same positions; 0 where there is none."""
    each = evidence.groupBy(*on, sample).agg(F.sum(amount).alias("_a"))
    sums = each.groupBy(*on).agg(F.count("*").alias("n_samples"), F.array_sort(F.collect_list(sample)).alias("samples"), F.sum("_a").alias("abundance"))
    found = edges.join(sums, on, "left")
    return found.withColumns({"n_samples": F.coalesce("n_samples", F.lit(0)).cast("long"), "abundance": F.coalesce("abundance", F.lit(0.0))})
