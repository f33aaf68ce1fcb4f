"""Queries from reads to splice graphs, read paths, phases and boundaries, each with the SQL that says the same.

A graph is made of the spliced reads of a hundred order keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import chains as C
from strandloom.operators import splice as S
from strandloom.scratch import stored
from strandloom.sources.tables import SPLICED_SQL, spliced

KEYS = ["graph"]
WIDTH = 128


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced(spark, sf_dir).withColumn("xs", F.when(F.col("qname") % 3 == 1, "+").when(F.col("qname") % 3 == 2, "-"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    rows = stored(_reads(spark, sf_dir), "reads")
    return rows, S.graph_tables(rows, KEYS, C.chain_counts(rows, KEYS), width=WIDTH)


def _text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "-")


def typed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[1]["regions"]


def partial_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tables(spark, sf_dir)[1]
    rows = S.classified(found["exons"], found["bounds"], found["junctions"], KEYS)
    return rows.withColumns({"ave": F.round("ave", 6), "dev": F.round("dev", 4)})


def junction_exon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[1]["links"]


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[1]["edges"].withColumn("w", F.round("w", 6))


def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[1]["vertices"].withColumn("w", F.round("w", 6))


def read_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read as a list of vertices, where it lies on its graph and every step is an edge."""
    rows, found = _tables(spark, sf_dir)
    paths = S.read_paths(rows, found["vertices"], KEYS, "qname", WIDTH)
    return S.on_graph(paths, found["edges"], KEYS, "qname").withColumn("path", _text("path"))


def phase_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by path, counted, with the exon coordinates of the path."""
    rows, found = _tables(spark, sf_dir)
    shapes = S.read_shapes(rows, KEYS)
    named = S.path_exons(S.shape_paths(shapes, found["vertices"], KEYS, WIDTH), found["vertices"], KEYS, "shape").join(shapes.select("graph", "shape", "n"), ["graph", "shape"])
    return named.select("graph", "n", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("exons")).groupBy("graph", "exons").agg(F.sum("n").alias("n"))


def distant_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vertices before and after each one do not abut it."""
    found = _tables(spark, sf_dir)[1]
    side = lambda s, name: S.distant(found["vertices"], found["edges"], KEYS, s).groupBy("graph", "v").agg(F.count("*").alias(name))
    rows = found["vertices"].where("run >= 0").select("graph", "v").join(side("t", "before"), ["graph", "v"], "left").join(side("s", "after"), ["graph", "v"], "left")
    return rows.select("graph", "v", F.coalesce("before", F.lit(0)).cast("long").alias("before"), F.coalesce("after", F.lit(0)).cast("long").alias("after"))


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a start or without an end, scored; the best of each graph is marked where it becomes a boundary."""
    found = _tables(spark, sf_dir)[1]
    out = None
    for side, name in (("t", "start"), ("s", "end")):
        scores = S.boundary_scores(found["vertices"], found["edges"], KEYS, side)
        best = S.new_boundaries(scores, KEYS, 1.0).select("graph", "first", F.lit(1).alias("best"))
        rows = scores.join(best, ["graph", "first"], "left").select("graph", F.lit(name).alias("side"), "first", "last", F.round("most", 6).alias("most"), F.round("amount", 6).alias("amount"), F.round("ratio", 6).alias("ratio"), F.coalesce("best", F.lit(0)).alias("best"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bridge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring reads of a graph as mates: the vertices between which they are bridged."""
    rows, found = _tables(spark, sf_dir)
    mate = rows.select("graph", (F.col("qname") - 1).alias("pair"), F.col("pos").alias("r_pos"), F.col("chain").alias("r_chain"))
    mates = rows.select("graph", F.col("qname").alias("pair"), "rpos", "chain").join(mate, ["graph", "pair"])
    return S.bridge_ends(mates, found["vertices"], KEYS, "pair", width=WIDTH)


def pier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.piers(bridge_ends(spark, sf_dir), KEYS)


def pseudo_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that light edges between neighbours span, and whether an intron of a read is one."""
    rows, found = _tables(spark, sf_dir)
    light = S.adjacent_edges(found["vertices"], found["edges"], KEYS)
    gaps = stored(S.light_gaps(light, KEYS), "gaps")
    kept = S.without_introns(rows, gaps, KEYS, "qname").select("graph", "qname", F.size("chain").alias("_left"))
    counts = gaps.groupBy("graph").agg(F.count("*").cast("int").alias("n_gaps"))
    return rows.join(kept, ["graph", "qname"]).join(counts, "graph", "left").select("graph", "qname", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), (F.size("chain") - F.col("_left")).alias("dropped"))


QUERIES = [typed_regions, partial_exons, junction_exon_join, graph_edges, graph_vertices, read_paths, phase_paths, distant_vertices, boundary_scores, bridge_ends, pier_pairs, pseudo_introns]

_REGIONS = f"""{SPLICED_SQL}, rd AS MATERIALIZED (SELECT *, CASE qname % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' END AS xs FROM sp), bnd AS MATERIALIZED (SELECT graph, min(pos) AS s, max(rpos) AS e FROM rd GROUP BY 1),
jx AS (SELECT graph, xs, unnest(list_transform(range(1, len(chain), 2), lambda i: {{'l': chain[i], 'r': chain[i + 1]}})) AS j FROM rd),
jn AS MATERIALIZED (SELECT graph, j.l AS l, j.r AS r, count(*) AS c, CASE WHEN count(*) FILTER (xs = '+') > count(*) FILTER (xs = '-') THEN '+' WHEN count(*) FILTER (xs = '+') < count(*) FILTER (xs = '-') THEN '-' ELSE '.' END AS strand FROM jx GROUP BY 1, 2, 3),
pt AS (SELECT graph, s AS p, 'start' AS t FROM bnd UNION ALL SELECT graph, e, 'end' FROM bnd UNION ALL SELECT graph, l, 'left' FROM jn UNION ALL SELECT graph, r, 'right' FROM jn),
ty AS (SELECT graph, p, bool_or(t = 'start') AS st, bool_or(t = 'end') AS en, bool_or(t = 'left') AS le, bool_or(t = 'right') AS ri FROM pt GROUP BY 1, 2),
rg AS MATERIALIZED (SELECT * FROM (SELECT graph, p AS s, lead(p) OVER k AS e, CASE WHEN st THEN 'start' WHEN en THEN 'end' WHEN ri THEN 'right' ELSE 'left' END AS lt,
lead(CASE WHEN st THEN 'start' WHEN en THEN 'end' WHEN le THEN 'left' ELSE 'right' END) OVER k AS rt FROM ty WINDOW k AS (PARTITION BY graph ORDER BY p)) WHERE e IS NOT NULL)"""
_EXONS = f"""{_REGIONS}, ch AS (SELECT graph, p, sum(w) AS w FROM (SELECT floor(qname / 100)::BIGINT AS graph, s AS p, 1 AS w FROM blk UNION ALL SELECT floor(qname / 100)::BIGINT, e, -1 FROM blk) GROUP BY 1, 2 HAVING sum(w) <> 0),
dp AS MATERIALIZED (SELECT * FROM (SELECT graph, p AS s, lead(p) OVER k AS e, sum(w) OVER (PARTITION BY graph ORDER BY p ROWS UNBOUNDED PRECEDING)::BIGINT AS d FROM ch WINDOW k AS (PARTITION BY graph ORDER BY p)) WHERE d <> 0),
pc AS (SELECT r.*, CASE WHEN lt = 'right' AND rt = 'left' THEN 15 ELSE 0 END AS gap, greatest(r.s, dp.s) AS a, least(r.e, dp.e) AS b, dp.d FROM rg r JOIN dp ON r.graph = dp.graph AND dp.s < r.e AND r.s < dp.e),
pm AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY graph, s ORDER BY a) > gap THEN 1 ELSE 0 END AS nw2 FROM pc), pi AS (SELECT *, sum(nw2) OVER (PARTITION BY graph, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM pm),
i0 AS MATERIALIZED (SELECT graph, s, e, lt, rt, gap, min(a) AS a, max(b) AS b, sum(b - a)::BIGINT AS cover, sum((b - a) * d)::BIGINT AS area, sum((b - a) * d * d)::BIGINT AS sq, max(d) AS mx FROM pi GROUP BY graph, s, e, lt, rt, gap, i),
i1 AS MATERIALIZED (SELECT graph, s, e, lt, rt, CASE WHEN a - s <= gap THEN s ELSE a END AS a, CASE WHEN e - b <= gap THEN e ELSE b END AS b, cover, area, sq, mx FROM i0
UNION ALL SELECT graph, s, e, lt, rt, s, e, 0, 0, 0, 0 FROM rg WHERE lt = 'right' AND rt = 'left' AND e - s <= 15 AND NOT EXISTS (SELECT 1 FROM i0 WHERE i0.graph = rg.graph AND i0.s = rg.s)),
ex0 AS (SELECT graph, a AS s, b AS e, CASE WHEN a = s THEN lt ELSE 'start' END AS lt, CASE WHEN b = e THEN rt ELSE 'end' END AS rt, area / (b - a) AS ave, sqrt(greatest(0.0, (sq - 2 * area / (b - a) * area + area / (b - a) * area / (b - a) * cover) / (b - a))) AS dev, mx FROM i1
WHERE (a = s AND b = e) OR (a = s AND lt = 'right') OR (b = e AND rt = 'left') OR (b - a >= 15 AND area / (b - a) >= 1.5)
UNION ALL SELECT graph, s, s + 1, 'right', 'end', 0.01, 1.0, 0 FROM rg WHERE lt = 'right' AND NOT EXISTS (SELECT 1 FROM i1 WHERE i1.graph = rg.graph AND i1.s = rg.s AND i1.a = rg.s)
UNION ALL SELECT graph, e - 1, e, 'start', 'left', 0.01, 1.0, 0 FROM rg WHERE rt = 'left' AND NOT EXISTS (SELECT 1 FROM i1 WHERE i1.graph = rg.graph AND i1.e = rg.e AND i1.b = rg.e)),
ex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY s, e) AS vid FROM ex0),
ln AS MATERIALIZED (SELECT jn.*, a.vid AS lexon, b.vid AS rexon FROM jn JOIN ex a ON jn.graph = a.graph AND jn.l = a.e JOIN ex b ON jn.graph = b.graph AND jn.r = b.s)"""
_EDGES = f"""{_EXONS}, nr AS (SELECT *, CASE WHEN lag(e) OVER k = s THEN lag(ave) OVER k END AS pa, CASE WHEN lead(s) OVER k = e THEN lead(ave) OVER k END AS na, max(vid) OVER (PARTITION BY graph) AS n FROM ex WINDOW k AS (PARTITION BY graph ORDER BY vid)),
fe AS (SELECT graph, lexon AS s, rexon AS t, c::DOUBLE AS w, 'junction' AS kind, strand FROM ln UNION ALL SELECT graph, 0, vid, greatest(ave - coalesce(pa, 0), 0.01), 'source', '.' FROM nr WHERE lt = 'start'
UNION ALL SELECT graph, vid, n + 1, greatest(ave - coalesce(na, 0), 0.01), 'sink', '.' FROM nr WHERE rt = 'end'),
od AS (SELECT graph, s AS vid, count(*) AS o FROM fe GROUP BY 1, 2), id AS (SELECT graph, t - 1 AS vid, count(*) AS i FROM fe GROUP BY 1, 2),
ed AS MATERIALIZED (SELECT * FROM fe UNION ALL SELECT graph, vid, vid + 1, greatest(CASE WHEN coalesce(o, 0) < coalesce(i, 0) THEN ave WHEN coalesce(o, 0) > coalesce(i, 0) THEN na ELSE least(ave, na) END, 0.01), 'adjacent', '.'
FROM nr LEFT JOIN od USING (graph, vid) LEFT JOIN id USING (graph, vid) WHERE na IS NOT NULL)"""
_VERTICES = f"""{_EDGES}, vr AS MATERIALIZED (SELECT graph, vid AS v, s AS lpos, e AS rpos, greatest(ave, 0.01) AS w, sum(CASE WHEN pe IS NOT NULL AND pe <> s THEN 1 ELSE 0 END) OVER (PARTITION BY graph ORDER BY vid ROWS UNBOUNDED PRECEDING)::BIGINT AS run
FROM (SELECT *, lag(e) OVER (PARTITION BY graph ORDER BY vid) AS pe FROM ex))"""
_PATHS = f"""{_VERTICES}, fl AS (SELECT rd.graph, rd.qname, rd.chain, len(rd.chain) // 2 AS n, a.v AS u1, b.v AS u2 FROM rd JOIN vr a ON rd.graph = a.graph AND a.lpos <= rd.pos AND rd.pos < a.rpos JOIN vr b ON rd.graph = b.graph AND b.lpos <= rd.rpos - 1 AND rd.rpos - 1 < b.rpos),
jk AS (SELECT graph, qname, unnest(range(1, n + 1)) AS k, chain FROM fl), js AS (SELECT jk.graph, jk.qname, jk.k, d.v AS d, d.run AS dr, a.v AS a, a.run AS ar FROM jk JOIN vr d ON jk.graph = d.graph AND d.rpos = chain[2 * k - 1] JOIN vr a ON jk.graph = a.graph AND a.lpos = chain[2 * k]),
jl AS (SELECT graph, qname, list({{'d': d, 'dr': dr, 'a': a, 'ar': ar}} ORDER BY k) AS j FROM js GROUP BY 1, 2),
pa AS (SELECT fl.*, j FROM fl LEFT JOIN jl USING (graph, qname) WHERE u1 <= u2 AND (n = 0 OR (len(j) = n AND len(list_filter(range(1, n), lambda i: j[i].ar <> j[i + 1].dr OR j[i].a > j[i + 1].d)) = 0))),
path AS (SELECT graph, qname, CASE WHEN n = 0 THEN range(u1, u2 + 1) ELSE list_concat(list_concat(range(u1, j[1].d), [j[1].d]), list_concat(flatten(list_transform(range(1, n), lambda i: range(j[i].a, j[i + 1].d + 1))), list_concat([j[-1].a], range(j[-1].a + 1, u2 + 1)))) END AS p FROM pa)"""
_ENDS = f"""{_VERTICES}, nv AS (SELECT *, lag(rpos) OVER k = lpos AS bk, lead(lpos) OVER k = rpos AS fw FROM vr WINDOW k AS (PARTITION BY graph ORDER BY v)),
mt AS (SELECT a.graph, a.qname AS pair, a.rpos, list_max(a.chain) AS c1, b.pos AS r_pos, list_min(b.chain) AS c2 FROM rd a JOIN rd b ON a.graph = b.graph AND b.qname = a.qname + 1),
be AS (SELECT m.graph, m.pair, CASE WHEN coalesce(a.bk, false) AND m.rpos - a.lpos <= 10 AND (c1 IS NULL OR c1 < a.lpos) THEN a.v - 1 ELSE a.v END AS s, CASE WHEN coalesce(b.fw, false) AND b.rpos - m.r_pos <= 10 AND (c2 IS NULL OR c2 > b.rpos) THEN b.v + 1 ELSE b.v END AS t
FROM mt m JOIN nv a ON m.graph = a.graph AND a.lpos <= m.rpos - 1 AND m.rpos - 1 < a.rpos JOIN nv b ON m.graph = b.graph AND b.lpos <= m.r_pos AND m.r_pos < b.rpos)"""


def _scores_sql(side: str, name: str) -> str:
    other = "s" if side == "t" else "t"
    return f"""{name}_a AS (SELECT graph, run, min(v) AS f, max(v) AS l, max(w) AS most FROM vr GROUP BY 1, 2), {name}_b AS (SELECT e.graph, r.run, sum(CASE WHEN o.run IS NULL OR o.run <> r.run THEN e.w ELSE 0 END) AS amount, bool_or(o.run IS NULL) AS bound
FROM ed e JOIN vr r ON e.graph = r.graph AND e.{side} = r.v LEFT JOIN vr o ON e.graph = o.graph AND e.{other} = o.v GROUP BY 1, 2),
{name}_c AS (SELECT a.*, coalesce(amount, 0.0) AS amount, ln(2 + most) / ln(2 + coalesce(amount, 0.0)) AS ratio FROM {name}_a a LEFT JOIN {name}_b b USING (graph, run) WHERE NOT coalesce(bound, false)),
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY ratio DESC, run) AS k FROM {name}_c)"""


def _scores_rows(name: str, side: str) -> str:
    return f"""SELECT graph, '{side}' AS side, f AS "first", l AS "last", round(most, 6) AS most, round(amount, 6) AS amount, round(ratio, 6) AS ratio, (k = 1 AND ratio >= 1.0)::INTEGER AS best FROM {name}_d"""


SQL = {
    "typed_regions": f'WITH {_REGIONS} SELECT graph, s AS "start", e AS "end", lt AS ltype, rt AS rtype FROM rg',
    "partial_exons": f"""WITH {_EXONS} SELECT x.graph, vid, x.s AS "start", x.e AS "end", lt AS ltype, rt AS rtype, round(ave, 6) AS ave, round(dev, 4) AS dev, mx AS "max",
(CASE WHEN x.s = b.s OR x.e = b.e OR lt = 'right' OR rt = 'left' OR (lt = 'left' AND rt = 'right' AND (jn.c IS NULL OR jn.c < ave)) THEN 0 ELSE 1 END)::INTEGER AS kind FROM ex x JOIN bnd b ON x.graph = b.graph LEFT JOIN jn ON x.graph = jn.graph AND x.s = jn.l AND x.e = jn.r""",
    "junction_exon_join": f'WITH {_EXONS} SELECT graph, l, r, c AS "count", strand, lexon, rexon FROM ln',
    "graph_edges": f"WITH {_EDGES} SELECT graph, s, t, round(w, 6) AS w, kind, strand FROM ed",
    "graph_vertices": f"""WITH {_VERTICES}, n AS (SELECT graph, max(v) AS n FROM vr GROUP BY 1) SELECT graph, v, lpos, rpos, round(w, 6) AS w, run FROM vr UNION ALL SELECT graph, 0, s, s, 0.0, -1 FROM bnd UNION ALL SELECT bnd.graph, n + 1, e, e, 0.0, -2 FROM bnd JOIN n ON bnd.graph = n.graph""",
    "read_paths": f"""WITH {_PATHS}, st AS (SELECT graph, qname, unnest(list_transform(range(1, len(p)), lambda i: {{'s': p[i], 't': p[i + 1]}})) AS x FROM path),
bad AS (SELECT DISTINCT graph, qname FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.graph = st.graph AND ed.s = st.x.s AND ed.t = st.x.t))
SELECT graph, qname, array_to_string(p, '-') AS path FROM path WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.graph = path.graph AND bad.qname = path.qname)""",
    "phase_paths": f"""WITH {_PATHS}, st AS (SELECT graph, qname, unnest(range(1, len(p) + 1)) AS k, p FROM path), vx AS (SELECT st.graph, qname, k, lpos, rpos, lag(rpos) OVER (PARTITION BY st.graph, qname ORDER BY k) AS pr FROM st JOIN vr ON st.graph = vr.graph AND vr.v = p[k]),
gx AS (SELECT *, sum(CASE WHEN pr = lpos THEN 0 ELSE 1 END) OVER (PARTITION BY graph, qname ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM vx), xx AS (SELECT graph, qname, g, min(lpos) AS s, max(rpos) AS e FROM gx GROUP BY 1, 2, 3),
xs AS (SELECT graph, qname, string_agg(s || '-' || e, ',' ORDER BY g) AS exons FROM xx GROUP BY 1, 2) SELECT graph, exons, count(*) AS n FROM xs GROUP BY 1, 2""",
    "distant_vertices": f"""WITH {_VERTICES}, dd AS (SELECT DISTINCT e.graph, a.v AS s, b.v AS t FROM ed e JOIN vr a ON e.graph = a.graph AND e.s = a.v JOIN vr b ON e.graph = b.graph AND e.t = b.v WHERE a.rpos <> b.lpos),
x AS (SELECT graph, t AS v, count(*) AS c FROM dd GROUP BY 1, 2), y AS (SELECT graph, s AS v, count(*) AS c FROM dd GROUP BY 1, 2)
SELECT vr.graph, vr.v, coalesce(x.c, 0)::BIGINT AS "before", coalesce(y.c, 0)::BIGINT AS "after" FROM vr LEFT JOIN x USING (graph, v) LEFT JOIN y ON vr.graph = y.graph AND vr.v = y.v""",
    "boundary_scores": f"WITH {_VERTICES}, {_scores_sql('t', 'sb')}, {_scores_sql('s', 'eb')} {_scores_rows('sb', 'start')} UNION ALL {_scores_rows('eb', 'end')}",
    "bridge_ends": f"WITH {_ENDS} SELECT * FROM be",
    "pier_pairs": f"WITH {_ENDS} SELECT DISTINCT graph, s, t FROM be WHERE s < t",
    "pseudo_introns": f"""WITH {_VERTICES}, ae AS (SELECT graph, v AS s, lead(v) OVER k AS t, rpos AS l, lead(lpos) OVER k AS r FROM vr WINDOW k AS (PARTITION BY graph ORDER BY v)),
gp AS (SELECT DISTINCT graph, l, r FROM ae WHERE t IS NOT NULL AND l < r AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.graph = ae.graph AND ed.s = ae.s AND ed.t = ae.t)), gn AS (SELECT graph, count(*) AS n FROM gp GROUP BY 1),
rj AS (SELECT graph, qname, unnest(list_transform(range(1, len(chain), 2), lambda i: {{'l': chain[i], 'r': chain[i + 1]}})) AS j FROM rd), dr AS (SELECT rj.graph, qname, count(*) AS c FROM rj JOIN gp ON rj.graph = gp.graph AND j.l = gp.l AND j.r = gp.r GROUP BY 1, 2)
SELECT rd.graph, rd.qname, coalesce(gn.n, 0)::INTEGER AS n_gaps, (2 * coalesce(dr.c, 0))::INTEGER AS dropped FROM rd LEFT JOIN gn ON rd.graph = gn.graph LEFT JOIN dr ON rd.graph = dr.graph AND rd.qname = dr.qname""",
}
