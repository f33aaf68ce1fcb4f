"""Path, gene and vertex features that compare a row with others of its graph or place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import BIN, overlapping


def smallest_edges(edges: DataFrame, side: str, rank: int = 1) -> DataFrame:
    """(graph, v, s, t, w, ratio): the `rank`-th smallest edge into (side "t") or out of (side "s") each vertex.

    ratio is its share of the side's weight; ties go to the larger other end.
    """
    other = "s" if side == "t" else "t"
    total = Window.partitionBy("graph", side)
    order = total.orderBy("w", F.desc(other))
    marked = edges.withColumns({"_r": F.row_number().over(order), "_sum": F.sum("w").over(total)})
    return marked.where(F.col("_r") == rank).select("graph", F.col(side).alias("v"), "s", "t", "w", (F.col("w") / F.col("_sum")).alias("ratio"))


def strand_degrees(edges: DataFrame) -> DataFrame:
    """(graph, v, in0, in1, in2, out0, out1, out2): in- and out-degrees by strand (0 none, 1 +, 2 -)."""
    ends = edges.select("graph", "strand", F.explode(F.array(F.struct(F.col("t").alias("v"), F.lit("in").alias("d")), F.struct(F.col("s").alias("v"), F.lit("out").alias("d")))).alias("x")).select("graph", "strand", "x.v", "x.d")
    return ends.groupBy("graph", "v").agg(*(F.count_if((F.col("d") == d) & (F.col("strand") == s)).alias(f"{d}{s}") for d in ("in", "out") for s in (0, 1, 2)))


def mixed_vertices(degrees: DataFrame) -> DataFrame:
    """Vertices that touch edges of both strands."""
    return degrees.where("in1 + out1 > 0 and in2 + out2 > 0").select("graph", "v")


def successors(phases: DataFrame, path: str = "path", count: str = "n") -> DataFrame:
    """(graph, a, b, n): how often b follows a in the phases."""
    steps = phases.select("graph", count, F.posexplode(path).alias("k", "a"), F.col(path).alias("_p")).where(F.col("k") < F.size("_p") - 1)
    return steps.groupBy("graph", "a", F.col("_p")[F.col("k") + 1].alias("b")).agg(F.sum(count).alias("n"))


def not_subsumed(chains: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """Distinct chains that are no consecutive part of a longer one of their keys.

    Candidates meet on the first element, so a chain is compared only with longer ones that hold it.
    """
    own = chains.select(*keys, F.col(chain).alias("chain")).distinct().where(F.size("chain") > 0)
    held = own.select(*keys, F.col("chain").alias("_long"), F.posexplode("chain").alias("_k", "_first"))
    short = own.withColumn("_first", F.col("chain")[0])
    inside = short.join(held, [*keys, "_first"]).where((F.size("_long") > F.size("chain")) & (F.slice("_long", F.col("_k") + 1, F.size("chain")) == F.col("chain")))
    return own.join(inside.select(*keys, "chain").distinct(), [*keys, "chain"], "left_anti")


def retained_introns(introns: DataFrame, exons: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, path, n_retained): introns (path, start, end) of a path that an exon (r_path, r_start, r_end) of another holds whole."""
    met = overlapping(introns, exons, keys, width).where("path <> r_path and r_start <= start and end <= r_end")
    return met.select(*keys, "path", "start", "end").distinct().groupBy(*keys, "path").agg(F.count("*").alias("n_retained"))


def best_overlap(regions: DataFrame, genes: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, start, end, gene, overlap): the gene (gene, r_start, r_end) that overlaps each region most; ties to the smaller name."""
    met = overlapping(regions, genes, keys, width)
    best = met.groupBy(*keys, "start", "end").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("gene").alias("gene"))).alias("_b"))
    return best.select(*keys, "start", "end", F.col("_b.gene").alias("gene"), (-F.col("_b.o")).alias("overlap"))


def gene_bounds(exons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, n_boundaries) over exons (start, end)."""
    return exons.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_union(F.collect_set("start"), F.collect_set("end"))).cast("long").alias("n_boundaries"))


def boundary_evidence(mates: DataFrame, vertices: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, v, count, ratio): unbridged mates whose position p lies in a vertex (v, lpos, rpos, w); log(1+x+w) - log(1+w)."""
    from strandloom.operators.intervals import containing

    met = containing(mates, vertices, keys, "p", "lpos", "rpos", width)
    sums = met.groupBy(*keys, "v", "w").agg(F.count("*").alias("count"))
    return sums.select(*keys, "v", "count", (F.log1p(F.col("count") + F.col("w")) - F.log1p("w")).alias("ratio"))


def primary_only(hits: DataFrame, keys: list[str], primary: str) -> DataFrame:
    """Hits that are primary, or whose keys have no primary hit."""
    best = hits.groupBy(*keys).agg(F.max(primary).alias("_any"))
    return hits.join(best, keys).where(F.col(primary) | ~F.col("_any")).drop("_any")


def projected_bounds(phases: DataFrame, starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Phase paths (first, last) with their ends moved where `starts` (from_p, to_p) or `ends` say so."""
    a = starts.select(*keys, F.col("from_p").alias("first"), F.col("to_p").alias("_a"))
    b = ends.select(*keys, F.col("from_p").alias("last"), F.col("to_p").alias("_b"))
    moved = phases.join(a, [*keys, "first"], "left").join(b, [*keys, "last"], "left")
    return moved.withColumns({"first": F.coalesce("_a", "first"), "last": F.coalesce("_b", "last")}).drop("_a", "_b").select(*phases.columns)


def size_histogram(rows: DataFrame, size: str) -> DataFrame:
    return rows.groupBy(size).agg(F.count("*").alias("n"))
