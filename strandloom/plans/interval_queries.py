"""Queries on reads, islands and depth, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import intervals as I
from strandloom.operators import reads as R
from strandloom.sources.tables import EVENTS_SQL, READS_SQL, events, reads

GAP = 0
REGION = 365
BUNDLE = ["sample_id", "chrm", "strand"]
WIDTH = 256


def read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    kept = rows.where((F.col("qual") >= 1) & (F.abs(F.col("rpos") - F.col("pos")) < 45))
    return kept.select("sample_id", "chrm", "strand", "pos", "rpos", "qual", "qname", "part", "line")


def run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.drop_runs(reads(spark, sf_dir), ["sample_id", "chrm"], ["pos", "rpos", "strand"], ["pos", "rpos"])
    return rows.select("sample_id", "chrm", "strand", "pos", "rpos")


def gap_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_islands(reads(spark, sf_dir), BUNDLE, "pos", "rpos", GAP, WIDTH).withColumnRenamed("n", "n_reads")


def region_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    islands = I.merge_islands(reads(spark, sf_dir), ["sample_id", "chrm"], "pos", "rpos", GAP, WIDTH)
    region = F.floor(F.col("start") / REGION).cast("long")
    return islands.groupBy("sample_id", "chrm", region.alias("region")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_islands"), F.sum("n").alias("n_reads"))


def depth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.depth(reads(spark, sf_dir), ["chrm", "strand"], "pos", "rpos", width=WIDTH)


def bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads into bundles, and each bundle's depth profile in figures."""
    bundled = I.assign_islands(reads(spark, sf_dir), BUNDLE, "pos", "rpos", GAP, WIDTH)
    keys = [*BUNDLE, "island_start", "island_end"]
    stats = I.rectangles(I.depth(bundled, keys, "pos", "rpos", width=WIDTH), keys)
    return stats.select(*keys, "covered", "area", "max_depth", F.round("mean_depth", 6).alias("mean_depth"), F.round("dev_depth", 4).alias("dev_depth"))


def segment_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reads(spark, sf_dir).select(*BUNDLE, F.explode(F.array("pos", "rpos")).alias("p"))
    return I.segments(points, BUNDLE)


def island_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = I.depth(reads(spark, sf_dir), BUNDLE, "pos", "rpos", width=WIDTH).where("depth >= 2").select(*BUNDLE, "start", "end")
    return I.merge_islands(pieces, BUNDLE, "start", "end", 15, WIDTH).withColumnRenamed("n", "n_pieces")


def strand_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = reads(spark, sf_dir).groupBy("sample_id", "chrm").agg(F.count_if(F.col("strand") == "+").alias("n_plus"), F.count_if(F.col("strand") == "-").alias("n_minus"))
    return sums.withColumn("strand", F.when(F.col("n_plus") > F.col("n_minus"), "+").when(F.col("n_plus") < F.col("n_minus"), "-").otherwise("."))


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    pieces = I.merge_islands(rows.where("strand = '+'"), ["sample_id", "chrm"], "pos", "rpos", GAP, WIDTH).drop("n")
    points = rows.where("strand = '-'").select("sample_id", "chrm", F.col("pos").alias("p")).distinct()
    return I.containing(points, pieces, ["sample_id", "chrm"], "p", width=WIDTH).select("sample_id", "chrm", "p", "start", "end")


def overlap_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    islands = lambda s: I.merge_islands(rows.where(F.col("strand") == s), ["sample_id", "chrm"], "pos", "rpos", GAP, WIDTH).drop("n")
    met = I.overlapping(islands("+"), islands("-").withColumnsRenamed({"start": "r_start", "end": "r_end"}), ["sample_id", "chrm"], WIDTH)
    return met.groupBy("sample_id", "chrm").agg(F.count("*").alias("n_pairs"), F.sum("overlap").cast("long").alias("overlap"))


def nested_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of either strand that lie strictly within no bundle of the other strand."""
    islands = I.merge_islands(reads(spark, sf_dir), BUNDLE, "pos", "rpos", GAP, WIDTH).drop("n")
    other = islands.select("sample_id", "chrm", F.translate("strand", "+-", "-+").alias("strand"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = I.overlapping(islands, other, BUNDLE, WIDTH).where("r_start < start and end < r_end").select(*BUNDLE, "start", "end").distinct()
    return islands.join(inside, [*BUNDLE, "start", "end"], "left_anti")


def containment_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumnsRenamed({"pos": "start", "rpos": "end"})
    return I.without_contained(rows, ["sample_id", "chrm"], width=WIDTH)


def boundary_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    right = rows.where("event_type = 'view'").select("user_id", F.col("at").alias("view_at"))
    return I.asof(left, right, ["user_id"], "at", "view_at", 86_400, "event_id")


QUERIES = [read_filter, run_dedup, gap_bundles, region_cut, depth_sweep, bundle_stats, segment_lead, island_merge, strand_vote, point_in_interval, overlap_length, nested_anti, containment_anti, boundary_asof]


def _islands_sql(name: str, source: str, keys: str, start: str = "pos", end: str = "rpos", gap: int = 0, also: str = "") -> str:
    return f"""{name}_f AS (SELECT *, CASE WHEN {start} > max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS nw FROM {source}),
{name}_g AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f),
{name} AS (SELECT {keys}, min({start})::INTEGER AS "start", max({end})::INTEGER AS "end", count(*) AS n FROM {name}_g GROUP BY {keys}, g)"""


def _depth_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, p, sum(w) AS w FROM (SELECT {keys}, pos AS p, 1 AS w FROM {source} UNION ALL SELECT {keys}, rpos, -1 FROM {source}) GROUP BY {keys}, p HAVING sum(w) <> 0),
{name} AS (SELECT * FROM (SELECT {keys}, p AS "start", lead(p) OVER k AS "end", sum(w) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM {name}_c WINDOW k AS (PARTITION BY {keys} ORDER BY p)) WHERE depth <> 0)"""


_B = "sample_id, chrm, strand"
SQL = {
    "read_filter": f"WITH {READS_SQL} SELECT {_B}, pos, rpos, qual, qname, part, line FROM reads WHERE qual >= 1 AND abs(rpos - pos) < 45",
    "run_dedup": f"WITH {READS_SQL} SELECT {_B}, pos, rpos FROM (SELECT *, lag(pos) OVER w AS p, lag(rpos) OVER w AS r FROM reads WINDOW w AS (PARTITION BY sample_id, chrm ORDER BY pos, rpos, strand)) WHERE p IS DISTINCT FROM pos OR r IS DISTINCT FROM rpos",
    "gap_bundles": f'WITH {READS_SQL}, {_islands_sql("isl", "reads", _B)} SELECT {_B}, "start", "end", n AS n_reads FROM isl',
    "region_cut": f'WITH {READS_SQL}, {_islands_sql("isl", "reads", "sample_id, chrm")} SELECT sample_id, chrm, floor("start" / {REGION})::BIGINT AS region, min("start") AS "start", max("end") AS "end", count(*) AS n_islands, sum(n)::BIGINT AS n_reads FROM isl GROUP BY 1, 2, 3',
    "depth_sweep": f'WITH {READS_SQL}, {_depth_sql("d", "reads", "chrm, strand")} SELECT * FROM d',
    "bundle_stats": f"""WITH {READS_SQL}, {_islands_sql("isl", "reads", _B)},
b AS (SELECT {_B}, g, min(pos) OVER w AS island_start, max(rpos) OVER w AS island_end, pos, rpos FROM isl_g WINDOW w AS (PARTITION BY {_B}, g)),
{_depth_sql("d", "b", _B + ", island_start, island_end")}
SELECT {_B}, island_start, island_end, covered, area, max_depth, round(area / covered, 6) AS mean_depth, round(sqrt(greatest(0.0, sq / covered - (area / covered) * (area / covered))), 4) AS dev_depth FROM (
SELECT {_B}, island_start, island_end, sum("end" - "start")::BIGINT AS covered, sum(("end" - "start") * depth)::BIGINT AS area, sum(("end" - "start") * depth * depth)::BIGINT AS sq, max(depth) AS max_depth FROM d GROUP BY {_B}, island_start, island_end)""",
    "segment_lead": f'WITH {READS_SQL}, p AS (SELECT {_B}, pos AS p FROM reads UNION SELECT {_B}, rpos FROM reads) SELECT * FROM (SELECT {_B}, p AS "start", lead(p) OVER (PARTITION BY {_B} ORDER BY p) AS "end" FROM p) WHERE "end" IS NOT NULL',
    "island_merge": f"""WITH {READS_SQL}, {_depth_sql("d", "reads", _B)}, d2 AS (SELECT {_B}, "start" AS s, "end" AS e FROM d WHERE depth >= 2),
{_islands_sql("isl", "d2", _B, "s", "e", 15)} SELECT {_B}, "start", "end", n AS n_pieces FROM isl""",
    "strand_vote": f"WITH {READS_SQL}, v AS (SELECT sample_id, chrm, count(*) FILTER (strand = '+') AS n_plus, count(*) FILTER (strand = '-') AS n_minus FROM reads GROUP BY 1, 2) SELECT *, CASE WHEN n_plus > n_minus THEN '+' WHEN n_plus < n_minus THEN '-' ELSE '.' END AS strand FROM v",
    "point_in_interval": f"""WITH {READS_SQL}, plus AS (SELECT * FROM reads WHERE strand = '+'), {_islands_sql("isl", "plus", "sample_id, chrm")}
SELECT DISTINCT r.sample_id, r.chrm, r.pos AS p, i."start", i."end" FROM reads r JOIN isl i ON r.sample_id = i.sample_id AND r.chrm = i.chrm AND i."start" <= r.pos AND r.pos < i."end" WHERE r.strand = '-'""",
    "overlap_length": f"""WITH {READS_SQL}, plus AS (SELECT * FROM reads WHERE strand = '+'), minus AS (SELECT * FROM reads WHERE strand = '-'), {_islands_sql("a", "plus", "sample_id, chrm")}, {_islands_sql("b", "minus", "sample_id, chrm")}
SELECT a.sample_id, a.chrm, count(*) AS n_pairs, sum(least(a."end", b."end") - greatest(a."start", b."start"))::BIGINT AS overlap FROM a JOIN b ON a.sample_id = b.sample_id AND a.chrm = b.chrm AND a."start" < b."end" AND b."start" < a."end" GROUP BY 1, 2""",
    "nested_anti": f"""WITH {READS_SQL}, {_islands_sql("isl", "reads", _B)}
SELECT {_B}, "start", "end" FROM isl a WHERE NOT EXISTS (SELECT 1 FROM isl b WHERE a.sample_id = b.sample_id AND a.chrm = b.chrm AND a.strand <> b.strand AND b."start" < a."start" AND a."end" < b."end")""",
    "containment_anti": f"""WITH {READS_SQL}, d AS (SELECT DISTINCT sample_id, chrm, pos AS "start", rpos AS "end" FROM reads)
SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.sample_id = b.sample_id AND a.chrm = b.chrm AND b."start" <= a."start" AND a."end" <= b."end" AND (a."start" <> b."start" OR a."end" <> b."end"))""",
    "boundary_asof": f"""WITH {EVENTS_SQL} SELECT l.user_id, l.event_id, l."at", max(r."at") AS view_at FROM ev l JOIN ev r ON l.user_id = r.user_id AND r."at" <= l."at" AND l."at" - r."at" <= 86400
WHERE l.event_type = 'purchase' AND r.event_type = 'view' GROUP BY 1, 2, 3""",
}
