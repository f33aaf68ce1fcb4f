"""Queries on features, vertices and genes, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import chains as C
from strandloom.operators import features as X
from strandloom.operators import intervals as I
from strandloom.plans.chain_queries import _GRAPHS, _flat, _graphs
from strandloom.plans.interval_queries import BUNDLE, GAP, WIDTH, _islands_sql
from strandloom.sources.tables import READS_SQL, reads

P = ["sample_id", "chrm"]


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.gap_clusters(reads(spark, sf_dir), BUNDLE, ["pos", "rpos"], 10)
    return rows.groupBy(*BUNDLE, "cluster").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("rpos").alias("last_rpos"), F.floor(F.avg("pos")).cast("long").alias("mean_pos")).drop("cluster")


def smallest_in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.smallest_edges(_graphs(spark, sf_dir), "t").withColumn("ratio", F.round("ratio", 9))


def second_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.smallest_edges(_graphs(spark, sf_dir), "s", 2).withColumn("ratio", F.round("ratio", 9))


def _stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    return rows.select(F.floor(F.col("qname") / 100).alias("graph"), F.col("line").cast("long").alias("s"), (F.col("line") + 1).cast("long").alias("t"), F.when(F.col("strand") == "+", 1).otherwise(2).alias("strand")).distinct()


def strand_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.strand_degrees(_stranded(spark, sf_dir))


def mixed_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mixed_vertices(X.strand_degrees(_stranded(spark, sf_dir)))


def phase_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("qname").agg(F.array_sort(F.collect_set("line")).alias("path"))
    return X.successors(rows.select(F.floor(F.col("qname") / 100).alias("graph"), "path", F.lit(1).alias("n")))


def not_subsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("qname").agg(F.array_sort(F.collect_set("line")).alias("chain"))
    return _flat(X.not_subsumed(rows.select(F.floor(F.col("qname") / 100).alias("graph"), "chain"), ["graph"]), "chain")


def retained_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    introns = rows.where("strand = '+'").select("part", F.col("qname").alias("path"), F.col("pos").alias("start"), F.col("rpos").alias("end"))
    exons = rows.where("strand = '-'").select("part", F.col("qname").alias("r_path"), F.col("pos").alias("r_start"), (F.col("pos") + 120).alias("r_end"))
    return X.retained_introns(introns, exons, ["part"], 64)


def locate_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    regions = rows.where("strand = '+'").select(*P, F.col("pos").alias("start"), F.col("rpos").alias("end")).distinct()
    genes = I.merge_islands(rows.where("strand = '-'"), P, "pos", "rpos", GAP, WIDTH).select(*P, F.col("start").alias("gene"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return X.best_overlap(regions, genes, P, WIDTH)


def gene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select(F.col("part").alias("gene"), F.col("pos").alias("start"), F.col("rpos").alias("end"))
    return X.gene_bounds(rows, ["gene"])


def boundary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    vertices = I.merge_islands(rows.where("strand = '+'"), P, "pos", "rpos", GAP, WIDTH).select(*P, F.col("start").alias("v"), F.col("start").alias("lpos"), F.col("end").alias("rpos"), F.col("n").alias("w"))
    return X.boundary_evidence(rows.where("strand = '-'").select(*P, F.col("pos").alias("p")), vertices, P, WIDTH).withColumn("ratio", F.round("ratio", 9))


def primary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("primary", F.col("qual") >= 5)
    return X.primary_only(rows, ["qname", "chrm"], "primary").select("qname", "chrm", "part", "line", "sample_id", "qual")


def project_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    islands = I.assign_islands(rows, P, "pos", "rpos", 30, WIDTH)
    starts = islands.where("pos - island_start between 1 and 20").select(*P, F.col("pos").alias("from_p"), F.col("island_start").alias("to_p")).distinct()
    ends = islands.where("island_end - rpos between 1 and 20").select(*P, F.col("rpos").alias("from_p"), F.col("island_end").alias("to_p")).distinct()
    moved = X.projected_bounds(rows.select(*P, F.col("pos").alias("first"), F.col("rpos").alias("last")), starts, ends, P)
    return moved.groupBy(*P, "first", "last").agg(F.count("*").alias("c"))


def bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.size_histogram(I.merge_islands(reads(spark, sf_dir), BUNDLE, "pos", "rpos", GAP, WIDTH).withColumnRenamed("n", "n_reads"), "n_reads")


QUERIES = [gap_clusters, smallest_in_edges, second_out_edges, strand_degree, mixed_vertices, phase_successors, not_subsumed, retained_introns, locate_gene, gene_bounds, boundary_evidence, primary_only, project_bounds, bundle_sizes]

_B = "sample_id, chrm, strand"
_LINES = f"{READS_SQL}, o AS (SELECT qname, floor(qname / 100)::BIGINT AS graph, list_sort(list_distinct(list(line))) AS path FROM reads GROUP BY 1, 2)"
_STRANDED = f"""{READS_SQL}, e AS (SELECT DISTINCT floor(qname / 100)::BIGINT AS graph, line::BIGINT AS s, (line + 1)::BIGINT AS t, CASE WHEN strand = '+' THEN 1 ELSE 2 END AS strand FROM reads),
x AS (SELECT graph, t AS v, 'in' AS d, strand FROM e UNION ALL SELECT graph, s, 'out', strand FROM e),
g AS (SELECT graph, v, {", ".join(f"count(*) FILTER (d = '{d}' AND strand = {s}) AS {d}{s}" for d in ("in", "out") for s in (0, 1, 2))} FROM x GROUP BY 1, 2)"""
_SMALL = "SELECT graph, {v} AS v, s, t, w, round(w / tot, 9) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY graph, {v} ORDER BY w, {o} DESC) AS r, sum(w) OVER (PARTITION BY graph, {v}) AS tot FROM edges) WHERE r = {r}"
_PLUS, _MINUS = ("{0} AS (SELECT * FROM reads WHERE strand = '{1}')".format(n, s) for n, s in (("plus", "+"), ("minus", "-")))
SQL = {
    "gap_clusters": f"""WITH {READS_SQL}, a AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY {_B} ORDER BY pos) > 10 THEN 1 ELSE 0 END AS n1 FROM reads), b AS (SELECT *, sum(n1) OVER (PARTITION BY {_B} ORDER BY pos RANGE UNBOUNDED PRECEDING) AS c1 FROM a),
c AS (SELECT *, CASE WHEN rpos - lag(rpos) OVER (PARTITION BY {_B}, c1 ORDER BY rpos) > 10 THEN 1 ELSE 0 END AS n2 FROM b), d AS (SELECT *, sum(n2) OVER (PARTITION BY {_B}, c1 ORDER BY rpos RANGE UNBOUNDED PRECEDING) AS c2 FROM c)
SELECT {_B}, count(*) AS n, min(pos) AS first_pos, max(rpos) AS last_rpos, floor(avg(pos))::BIGINT AS mean_pos FROM d GROUP BY {_B}, c1, c2""",
    "smallest_in_edges": f"WITH {_GRAPHS} {_SMALL.format(v='t', o='s', r=1)}",
    "second_out_edges": f"WITH {_GRAPHS} {_SMALL.format(v='s', o='t', r=2)}",
    "strand_degree": f"WITH {_STRANDED} SELECT * FROM g",
    "mixed_vertices": f"WITH {_STRANDED} SELECT graph, v FROM g WHERE in1 + out1 > 0 AND in2 + out2 > 0",
    "phase_successors": f"WITH {_LINES}, s AS (SELECT graph, unnest(list_transform(range(1, len(path)), lambda i: {{'a': path[i], 'b': path[i + 1]}})) AS x FROM o) SELECT graph, x.a AS a, x.b AS b, count(*) AS n FROM s GROUP BY 1, 2, 3",
    "not_subsumed": f"""WITH {_LINES}, c AS (SELECT DISTINCT graph, path FROM o) SELECT graph, array_to_string(path, '-') AS chain FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.graph = b.graph AND len(b.path) > len(a.path) AND contains('-' || array_to_string(b.path, '-') || '-', '-' || array_to_string(a.path, '-') || '-'))""",
    "retained_introns": f"""WITH {READS_SQL} SELECT part, path, count(*) AS n_retained FROM (SELECT DISTINCT a.part, a.qname AS path, a.pos, a.rpos FROM reads a JOIN reads b ON a.part = b.part AND a.qname <> b.qname AND b.pos <= a.pos AND a.rpos <= b.pos + 120
WHERE a.strand = '+' AND b.strand = '-') GROUP BY 1, 2""",
    "locate_gene": f"""WITH {READS_SQL}, {_MINUS}, {_islands_sql("isl", "minus", "sample_id, chrm")}, r AS (SELECT DISTINCT sample_id, chrm, pos, rpos FROM reads WHERE strand = '+'),
m AS (SELECT r.*, i."start" AS gene, least(r.rpos, i."end") - greatest(r.pos, i."start") AS overlap FROM r JOIN isl i ON r.sample_id = i.sample_id AND r.chrm = i.chrm AND i."start" < r.rpos AND r.pos < i."end")
SELECT sample_id, chrm, pos AS "start", rpos AS "end", gene, overlap FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrm, pos, rpos ORDER BY overlap DESC, gene) AS k FROM m) WHERE k = 1""",
    "gene_bounds": f'WITH {READS_SQL} SELECT part AS gene, min(pos) AS "start", max(rpos) AS "end", len(list_distinct(list_concat(list(pos), list(rpos)))) AS n_boundaries FROM reads GROUP BY 1',
    "boundary_evidence": f"""WITH {READS_SQL}, {_PLUS}, {_islands_sql("isl", "plus", "sample_id, chrm")}, m AS (SELECT i.sample_id, i.chrm, i."start" AS v, i.n AS w, count(*) AS c FROM isl i JOIN reads r ON r.strand = '-' AND i.sample_id = r.sample_id AND i.chrm = r.chrm AND i."start" <= r.pos AND r.pos < i."end" GROUP BY 1, 2, 3, 4)
SELECT sample_id, chrm, v, c AS "count", round(ln(1 + c + w) - ln(1 + w), 9) AS ratio FROM m""",
    "primary_only": f"WITH {READS_SQL}, m AS (SELECT *, max(qual) OVER (PARTITION BY qname, chrm) AS best FROM reads) SELECT qname, chrm, part, line, sample_id, qual FROM m WHERE qual >= 5 OR best < 5",
    "project_bounds": f"""WITH {READS_SQL}, {_islands_sql("isl", "reads", "sample_id, chrm", gap=30)}, b AS (SELECT *, min(pos) OVER w AS s0, max(rpos) OVER w AS e0 FROM isl_g WINDOW w AS (PARTITION BY sample_id, chrm, g)),
a AS (SELECT DISTINCT sample_id, chrm, pos, s0 FROM b WHERE pos - s0 BETWEEN 1 AND 20), z AS (SELECT DISTINCT sample_id, chrm, rpos, e0 FROM b WHERE e0 - rpos BETWEEN 1 AND 20)
SELECT r.sample_id, r.chrm, coalesce(a.s0, r.pos) AS "first", coalesce(z.e0, r.rpos) AS "last", count(*) AS c FROM reads r LEFT JOIN a USING (sample_id, chrm, pos) LEFT JOIN z ON r.sample_id = z.sample_id AND r.chrm = z.chrm AND r.rpos = z.rpos GROUP BY 1, 2, 3, 4""",
    "bundle_sizes": f'WITH {READS_SQL}, {_islands_sql("isl", "reads", _B)} SELECT n AS n_reads, count(*) AS n FROM isl GROUP BY 1',
}
