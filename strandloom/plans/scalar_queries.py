"""Queries on sequences, alignments and single transcripts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.operators import reads as R
from strandloom.operators import transcripts as T
from strandloom.sources.tables import CHAINS_SQL, READS_SQL, SPLICED_SQL, chains, reads, spliced, table


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "-", "x")


def _whole(c: Column) -> Column:
    return c.cast("int")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spliced reads as alignments: exons are M, gaps N; flags, mates and tags by the order key."""
    rows = spliced(spark, sf_dir)
    match = F.transform("exons", lambda x: F.struct(F.lit("M").alias("op"), (x["end"] - x["start"]).cast("int").alias("len")))
    skip = F.transform(A.introns(F.col("chain")), lambda x: F.struct(F.lit("N").alias("op"), (x["r"] - x["l"]).cast("int").alias("len")))
    cigar = F.flatten(F.zip_with(match, F.concat(skip, F.array(F.lit(None).cast("struct<op:string,len:int>"))), lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    q = F.col("qname")
    flag = F.lit(1) + F.when(q % 2 == 0, 0x40).otherwise(0x80) + F.when(q % 3 == 0, 0x10).otherwise(0) + F.when(q % 5 == 0, 0x20).otherwise(0)
    pick = lambda m: F.when(q % m == 1, "+").when(q % m == 2, "-")
    return rows.select("qname", "pos", cigar.alias("cigar"), flag.cast("int").alias("flag"), (F.col("pos") + (q % 7).cast("int") - 3).alias("mpos"), pick(4).alias("xs"), pick(5).alias("ts"))


def read_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read off an alignment: its end, chain, tags, strands and mate orientation."""
    rows = R.project(_alignments(spark, sf_dir))
    return rows.select(
        "qname", "rpos", _text(F.col("chain")).alias("introns"), _whole(F.col("spliced")).alias("has_splice"), "xs", A.intron_length(F.col("chain")).alias("intron_length"),
        _whole(A.increasing(F.col("chain"))).alias("increasing"), R.library_strand(F.lit("FR_FIRST")).alias("fr_first"), R.library_strand(F.lit("FR_SECOND")).alias("fr_second"),
        _whole(R.concordant()).alias("concordant"), F.size(A.match_blocks(F.col("pos"), F.col("cigar"))).alias("n_blocks"),
    )


def transcript_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is computed of one transcript: length, bounds, introns, key, label and filters."""
    rows = spliced(spark, sf_dir)
    x, cov = F.col("exons"), F.log1p(F.col("qname") % 50)
    return rows.select(
        "qname", A.exon_length(x).alias("length"), x[0]["start"].alias("first"), F.element_at(x, -1)["end"].alias("last"), _text(A.intron_chain(x)).alias("chain"), F.coalesce(A.first_intron(x)["l"], F.lit(-1)).alias("donor"),
        F.coalesce(A.first_intron(x)["r"], F.lit(-1)).alias("acceptor"), A.chain_key(x).alias("key"), A.label(F.lit("R"), x).alias("label"), _whole(T.long_and_covered(x, cov)).alias("kept"), _whole(T.long_exons(x, 8)).alias("long_exons"), F.size(x).alias("n_exons"),
    )


def exon_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons cut at every 16th position, and merged again where they abut."""
    rows = spliced(spark, sf_dir).withColumn("cut", A.split_at(F.col("exons"), 16))
    return rows.select("qname", F.size("cut").alias("n_cut"), F.explode(A.shrunk(F.col("cut"))).alias("x")).select("qname", "n_cut", "x.start", "x.end")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's chain of lines, a, beside that of the next order key, b."""
    own = reads(spark, sf_dir).groupBy("qname").agg(F.array_sort(F.collect_set("line")).alias("a"))
    return own.join(own.select((F.col("qname") - 1).alias("qname"), F.col("a").alias("b")), "qname")


def sequence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two sorted sequences lie to each other, their union where they agree, what they share, and where one lies in the other."""
    a, b = F.col("a"), F.col("b")
    merged = A.merged_chain(a, b)
    return _neighbours(spark, sf_dir).select(
        "qname", A.relation(a, b).alias("relation"), _text(merged).alias("merged"), _whole(merged.isNotNull()).alias("consistent"), F.size(F.array_intersect(a, b)).alias("shared"),
        _text(A.consecutive_offsets(a, b)).alias("offsets"), _whole(A.slices_equal(a, 0, b, 1, 2)).alias("slices"), A.overlap_of(F.array_min(a), F.array_max(a), F.array_min(b), F.array_max(b)).alias("overlap"),
    )


def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("qname").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "line", "pos"))), lambda x: x["line"]).alias("a"))
    a = F.col("a")
    to = F.create_map(*(F.lit(x).cast("int") for k in (1, 2, 4, 5, 7) for x in (k, 10 * k)))
    return rows.select("qname", A.argmax(a).alias("argmax"), A.argmin(a).alias("argmin"), _text(F.reverse(a)).alias("reversed"), _text(A.mapped(a, to)).alias("mapped"), _text(A.renumbered(a)).alias("renumbered"), _text(F.array_sort(F.map_keys(to))).alias("keys"))


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("p_type", " "), lambda x: x != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(parts).alias("n"), parts[0].alias("first"), F.col("p_size").cast("string").alias("size"))


def mean_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("part").agg(F.avg("quantity").alias("ave"), F.stddev_pop("quantity").alias("dev"))
    return rows.select("part", F.round("ave", 6).alias("ave"), F.round("dev", 6).alias("dev"))


def depth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of depth along each chromosome and strand."""
    from strandloom.operators import intervals as I

    found = I.triangles(I.depth(reads(spark, sf_dir), ["chrm", "strand"], "pos", "rpos"), ["chrm", "strand"])
    return found.select("chrm", "strand", F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"))


def rpkm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("part").agg(F.sum("quantity").alias("cov"))
    return T.scaled(rows, 0.125)


def sample_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of lines that at least three samples have, their counts and those one higher."""
    rows = reads(spark, sf_dir).groupBy("qname", "sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), "-").alias("chain"))
    return T.counted_at_least(rows, ["chain"], 3).withColumn("more", F.col("count") + 1)


def binomial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unlikely a part's reads on the + strand are, at even odds."""
    rows = reads(spark, sf_dir).groupBy("part").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("strand") == "+").cast("int").alias("x"))
    return rows.withColumn("score", T.binomial_score("n", "x", 0.5))


def near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one graph whose spliced chains differ by at most 60 positions an intron, as components; unspliced ones stay alone."""
    rows = spliced(spark, sf_dir).select("graph", F.col("qname").alias("id"), "chain")
    return T.near_clusters(rows, ["graph"], "chain", 60)


def jaccard_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of neighbouring bundles' positions, and the share of the first that the second has."""
    own = chains(spark, sf_dir)
    rows = own.join(own.select((F.col("bundle") - 1).alias("bundle"), F.col("chain").alias("b")), "bundle")
    from strandloom.operators.chains import jaccard

    common = F.size(F.array_intersect("chain", "b"))
    return rows.where(common > 0).select("bundle", common.alias("common"), F.round(jaccard(common, F.size("chain"), F.size("b")), 9).alias("jaccard"), F.round(common / F.size("chain"), 9).alias("directed"))


QUERIES = [read_projection, transcript_columns, exon_shrink, sequence_relations, sequence_functions, split_words, mean_dev, depth_trend, rpkm_scale, sample_support, binomial_score, near_clusters, jaccard_splices]

_NEXT = f"""{READS_SQL}, o AS (SELECT qname, list_sort(list_distinct(list(line))) AS a FROM reads GROUP BY 1),
z AS (SELECT x.qname, x.a, y.a AS b, greatest(x.a[1], y.a[1]) AS lo, least(x.a[-1], y.a[-1]) AS hi FROM o x JOIN o y ON y.qname = x.qname + 1),
w AS (SELECT *, list_filter(a, lambda v: v >= lo AND v <= hi) AS ia, list_filter(b, lambda v: v >= lo AND v <= hi) AS ib FROM z),
m AS (SELECT *, CASE WHEN lo > hi OR (ia = ib AND len(ia) % 2 = 0) THEN list_sort(list_distinct(list_concat(a, b))) END AS u FROM w)"""
SQL = {
    "read_projection": f"""WITH {SPLICED_SQL}, q AS (SELECT *, qname % 3 = 0 AS rev, qname % 5 = 0 AS mrev, qname % 2 = 0 AS fst, pos + (qname % 7)::INTEGER - 3 AS mpos FROM sp)
SELECT qname, rpos, array_to_string(chain, '-') AS introns, (len(x) > 1)::INTEGER AS has_splice,
coalesce(CASE qname % 4 WHEN 1 THEN '+' WHEN 2 THEN '-' END, CASE WHEN rev THEN CASE qname % 5 WHEN 1 THEN '-' WHEN 2 THEN '+' END ELSE CASE qname % 5 WHEN 1 THEN '+' WHEN 2 THEN '-' END END) AS xs,
(rpos - pos - list_sum(list_transform(x, lambda v: v.e - v.s)))::BIGINT AS intron_length, 1 AS increasing, CASE WHEN rev = fst THEN '+' ELSE '-' END AS fr_first, CASE WHEN rev = fst THEN '-' ELSE '+' END AS fr_second,
(rev <> mrev AND rev <> (pos <= mpos))::INTEGER AS concordant, len(x)::INTEGER AS n_blocks FROM q""",
    "transcript_columns": f"""WITH {SPLICED_SQL}, t AS (SELECT *, list_sum(list_transform(x, lambda v: v.e - v.s))::BIGINT AS length, len(x) AS n, ln(1 + qname % 50) AS cov FROM sp)
SELECT qname, length, pos AS "first", rpos AS "last", array_to_string(chain, '-') AS chain, CASE WHEN n > 1 THEN x[1].e ELSE -1 END AS donor, CASE WHEN n > 1 THEN x[2].s ELSE -1 END AS acceptor,
CASE WHEN n > 1 THEN array_to_string(chain, '-') ELSE '@' || ((pos + rpos) // 10000) END AS key, 'R:' || pos || '-' || rpos AS label,
(CASE WHEN n > 1 THEN length >= 100 + 20 * n AND cov >= 2.0 ELSE length >= 250 AND cov >= 3.5 END)::INTEGER AS kept, (len(list_filter(x, lambda v: v.e - v.s < 8)) = 0)::INTEGER AS long_exons, n::INTEGER AS n_exons FROM t""",
    "exon_shrink": f"""WITH {SPLICED_SQL}, c AS (SELECT qname, sum((e - 1) // 16 - s // 16 + 1)::INTEGER AS n_cut FROM blk GROUP BY 1) SELECT qname, n_cut, s AS "start", e AS "end" FROM blk JOIN c USING (qname)""",
    "sequence_relations": f"""WITH {_NEXT} SELECT qname, CASE WHEN a = b THEN 'identical' WHEN a[-1] < b[1] THEN 'apart_left' WHEN b[-1] < a[1] THEN 'apart_right'
WHEN ia = ib AND a[1] <= b[1] AND b[-1] <= a[-1] THEN 'contains' WHEN ia = ib AND b[1] <= a[1] AND a[-1] <= b[-1] THEN 'contained' WHEN ia = ib AND a[1] < b[1] THEN 'extends_left' WHEN ia = ib AND b[1] < a[1] THEN 'extends_right'
WHEN len(ib) = 0 AND b[1] < a[1] AND a[-1] < b[-1] THEN 'nested' WHEN len(ia) = 0 AND a[1] < b[1] AND b[-1] < a[-1] THEN 'nesting' ELSE 'conflicting' END AS relation,
array_to_string(u, '-') AS merged, (u IS NOT NULL)::INTEGER AS consistent, len(list_intersect(a, b))::INTEGER AS shared,
array_to_string(list_filter(range(0, len(a)), lambda i: i + len(b) <= len(a) AND a[i + 1 : i + len(b)] = b), '-') AS offsets, (len(a) >= 2 AND len(b) >= 3 AND a[1:2] = b[2:3])::INTEGER AS slices, hi - lo AS overlap FROM m""",
    "sequence_functions": f"""WITH {READS_SQL}, o AS (SELECT qname, list(line ORDER BY part, line, pos) AS a FROM reads GROUP BY 1)
SELECT qname, (list_position(a, list_max(a)) - 1)::INTEGER AS argmax, (list_position(a, list_min(a)) - 1)::INTEGER AS argmin, array_to_string(list_reverse(a), '-') AS reversed,
array_to_string(list_transform(a, lambda v: CASE WHEN v IN (3, 6) THEN 'x' ELSE (10 * v)::VARCHAR END), '-') AS mapped, array_to_string(list_transform(a, lambda v: list_position(list_sort(list_distinct(a)), v) - 1), '-') AS renumbered, '1-2-4-5-7' AS keys FROM o""",
    "split_words": "SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda v: v <> ''))::INTEGER AS n, list_filter(string_split(p_type, ' '), lambda v: v <> '')[1] AS \"first\", p_size::VARCHAR AS size FROM part",
    "mean_dev": f"WITH {READS_SQL} SELECT part, round(avg(quantity), 6) AS ave, round(stddev_pop(quantity), 6) AS dev FROM reads GROUP BY 1",
    "depth_trend": f"""WITH {READS_SQL}, c AS (SELECT chrm, strand, p, sum(w) AS w FROM (SELECT chrm, strand, pos AS p, 1 AS w FROM reads UNION ALL SELECT chrm, strand, rpos, -1 FROM reads) GROUP BY 1, 2, 3 HAVING sum(w) <> 0),
d AS (SELECT * FROM (SELECT chrm, strand, p AS s, lead(p) OVER k AS e, sum(w) OVER (PARTITION BY chrm, strand ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM c WINDOW k AS (PARTITION BY chrm, strand ORDER BY p)) WHERE depth <> 0)
SELECT chrm, strand, round(regr_slope(depth, (s + e) / 2), 8) AS slope, round(regr_intercept(depth, (s + e) / 2), 4) AS intercept FROM d GROUP BY 1, 2""",
    "rpkm_scale": f"WITH {READS_SQL} SELECT part, sum(quantity) AS cov, sum(quantity) * 0.125::DOUBLE AS rpkm FROM reads GROUP BY 1",
    "sample_support": f"""WITH {READS_SQL}, o AS (SELECT qname, sample_id, array_to_string(list_sort(list_distinct(list(line))), '-') AS chain FROM reads GROUP BY 1, 2)
SELECT chain, count(DISTINCT sample_id) AS "count", count(DISTINCT sample_id) + 1 AS more FROM o GROUP BY 1 HAVING count(DISTINCT sample_id) >= 3""",
    "binomial_score": f"""WITH {READS_SQL}, s AS (SELECT part, count(*)::INTEGER AS n, (count(*) FILTER (strand = '+'))::INTEGER AS x FROM reads GROUP BY 1)
SELECT *, floor(-100 * log10(list_sum(list_transform(range(x, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5::DOUBLE))))) + 1e-9)::BIGINT AS score FROM s""",
    "near_clusters": f"""WITH RECURSIVE {SPLICED_SQL}, c AS (SELECT graph, qname AS id, chain, len(chain) AS n FROM sp),
e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.graph = b.graph AND a.n = b.n AND a.n > 0 AND a.id <> b.id AND abs(a.chain[1] - b.chain[1]) <= 60 AND len(list_filter(range(1, a.n, 2), lambda i: abs(a.chain[i] - b.chain[i]) + abs(a.chain[i + 1] - b.chain[i + 1]) > 60)) = 0),
r(id, node) AS (SELECT id, id FROM c UNION SELECT r.id, e.v FROM r JOIN e ON r.node = e.u)
SELECT c.graph, c.id, min(r.node) AS cluster FROM c JOIN r ON c.id = r.id GROUP BY 1, 2""",
    "jaccard_splices": f"""WITH {CHAINS_SQL}, z AS (SELECT x.bundle, x.chain AS a, y.chain AS b, len(list_intersect(x.chain, y.chain)) AS c FROM chains x JOIN chains y ON y.bundle = x.bundle + 1)
SELECT bundle, c::INTEGER AS common, round(c / (len(a) + len(b) - c), 9) AS jaccard, round(c / len(a), 9) AS directed FROM z WHERE c > 0""",
}
