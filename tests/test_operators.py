"""Hand-sized cases of the interval, chain, mate, transcript and graph operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.config import Parameters, for_data_type
from strandloom.functions import arrays as A
from strandloom.operators import chains as C
from strandloom.operators import graphs as G
from strandloom.operators import intervals as I
from strandloom.operators import mates as M
from strandloom.operators import reads as R
from strandloom.operators import transcripts as T


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def cigar(text):
    import re

    return [(op, int(n)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)]


READ = "qname string, pos int, cigar array<struct<op:string,len:int>>, flag int, xs string, ts string, qual int, mpos int, nh int, strand string"


def read(qname, pos, ops, flag=0, xs=None, ts=None, qual=10, mpos=0, nh=1, strand=None):
    return (qname, pos, cigar(ops), flag, xs, ts, qual, mpos, nh, strand)


def test_cigar_projections(spark):
    df = R.project(spark.createDataFrame([read("a", 100, "10M50N10M"), read("b", 0, "5N10M"), read("c", 10, "5S10M2I3D5M20N7="), read("d", 0, "4M3N4M5N4M", 0x10, None, "+")], READ))
    got = {r.qname: (r.rpos, r.chain, r.spliced, r.xs) for r in df.collect()}
    assert got == {"a": (170, [110, 160], True, None), "b": (15, [], True, None), "c": (55, [28, 48], True, None), "d": (20, [4, 7, 11, 16], True, "-")}
    blocks = df.where("qname = 'c'").select(A.match_blocks(F.col("pos"), F.col("cigar")).alias("b")).first().b
    assert [tuple(x) for x in blocks] == [(10, 20), (23, 28), (48, 55)]


def test_filters_and_routing(spark):
    data = [read("ok", 0, "10M"), read("low", 0, "10M", qual=0), read("unmapped", 0, "10M", 0x4), read("empty", 0, ""), read("far", 0, "10M", 0, mpos=600_000), read("wide", 0, "10M600000N10M"), read("multi", 0, "10M", nh=3)]
    df = R.project(spark.createDataFrame(data, READ))
    assert [x[0] for x in rows(R.accepted(df), "qname")] == ["multi", "ok"]
    assert [x[0] for x in rows(R.accepted(df, Parameters(uniquely_mapped_only=True)), "qname")] == ["ok"]
    routed = R.routed(R.project(spark.createDataFrame([read("p", 0, "5M", strand="+"), read("x", 0, "5M", xs="-"), read("both", 0, "5M"), read("none", 0, "5M9N5M"), read("clash", 0, "5M", strand="+", xs="-")], READ)))
    assert rows(routed, "qname", "bundle_strand") == [("both", "+"), ("both", "-"), ("none", "."), ("p", "+"), ("x", "-")]


def test_strands_from_flags(spark):
    df = spark.createDataFrame([(0x1 | 0x40,), (0x1 | 0x40 | 0x10,), (0x1 | 0x80,), (0x1 | 0x80 | 0x10,)], "flag int")
    first = [r.s for r in df.select(R.library_strand(F.lit("FR_FIRST")).alias("s")).collect()]
    second = [r.s for r in df.select(R.library_strand(F.lit("FR_SECOND")).alias("s")).collect()]
    assert first == ["-", "+", "+", "-"] and second == ["+", "-", "-", "+"]
    assert df.select(R.library_strand(F.lit("UNSTRANDED")).alias("s")).first().s is None


def test_run_duplicates_are_runs(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 5, 15), (4, 0, 10)], "hid int, pos int, rpos int").withColumn("k", F.lit(1))
    assert rows(R.drop_runs(df, ["k"], ["hid"], ["pos", "rpos"]), "hid") == [(1,), (3,), (4,)]


@pytest.mark.parametrize("width", [1 << 14, 7])
def test_islands_and_gaps(spark, width):
    df = spark.createDataFrame([("a", 0, 100), ("a", 300, 400), ("a", 601, 700), ("b", 5, 6)], "k string, start int, end int")
    assert rows(I.merge_islands(df, ["k"], gap=200, width=width), "k", "start", "end", "n") == [("a", 0, 400, 2), ("a", 601, 700, 1), ("b", 5, 6, 1)]
    assert rows(I.assign_islands(df, ["k"], gap=200, width=width), "start", "island_start", "island_end") == [(0, 0, 400), (5, 5, 6), (300, 0, 400), (601, 601, 700)]


@pytest.mark.parametrize("width", [1 << 14, 5])
def test_depth_equals_brute_force(spark, width):
    rng = random.Random(width)
    data = [(s, s + rng.randrange(0, 12)) for s in (rng.randrange(60) for _ in range(40))]
    got = rows(I.depth(spark.createDataFrame(data, "start int, end int").withColumn("k", F.lit(1)), ["k"], width=width), "start", "end", "depth")
    at = [sum(s <= p < e for s, e in data) for p in range(80)]
    assert sum((e - s) * d for s, e, d in got) == sum(at)
    assert all(at[p] == d for s, e, d in got for p in range(s, e))


def test_rectangles(spark):
    pieces = spark.createDataFrame([(1, 0, 5, 2), (1, 5, 10, 4)], "k int, start int, end int, depth long")
    assert rows(I.rectangles(pieces, ["k"]), "mean_depth", "dev_depth", "max_depth", "covered") == [(3.0, 1.0, 4, 10)]
    slope, intercept = I.triangles(pieces, ["k"]).select("slope", "intercept").first()
    assert math.isclose(slope, 0.4) and math.isclose(intercept, 1.0)


@pytest.mark.parametrize("width", [1 << 14, 3])
def test_interval_joins_equal_brute_force(spark, width):
    rng = random.Random(9)
    spans = lambda n: sorted({(s, s + rng.randrange(1, 15)) for s in (rng.randrange(50) for _ in range(n))})
    a, b = spans(20), spans(20)
    left = spark.createDataFrame([(1, *x) for x in a], "k int, start int, end int")
    right = spark.createDataFrame([(1, *x) for x in b], "k int, r_start int, r_end int")
    want = sorted((*x, *y, min(x[1], y[1]) - max(x[0], y[0])) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    assert rows(I.overlapping(left, right, ["k"], width), "start", "end", "r_start", "r_end", "overlap") == want
    points = spark.createDataFrame([(1, p) for p in range(60)], "k int, p int")
    assert rows(I.containing(points, left, ["k"], "p", width=width), "p", "start", "end") == sorted((p, *x) for p in range(60) for x in a if x[0] <= p < x[1])
    alone = sorted(x for x in a if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in a))
    assert rows(I.without_contained(left, ["k"], width=width), "start", "end") == alone


def test_asof_within_tolerance(spark):
    left = spark.createDataFrame([(1, 1, 10), (1, 2, 100), (1, 3, 401)], "k int, id int, at int")
    right = spark.createDataFrame([(1, 5), (1, 9), (1, 200), (2, 10)], "k int, seen int")
    assert rows(I.asof(left, right, ["k"], "at", "seen", 200, "id"), "id", "seen") == [(1, 9), (2, 9)]


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 5, 9], [5, 9, 12, 14], [2, 5], [(0, 10), (20, 30), (40, 45)])], "a array<int>, b array<int>, c array<int>, exons array<struct<start:int,end:int>>")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(A.increasing(F.col("a"))) and not one(A.increasing(F.array(F.lit(2), F.lit(2)))) and one(A.increasing(F.array()))
    assert [tuple(x) for x in one(A.pairs(F.col("c")))] == [(2, 5)] and one(A.pairs(F.array().cast("array<int>"))) == []
    assert one(A.intron_chain(F.col("exons"))) == [10, 20, 30, 40] and one(A.exon_length(F.col("exons"))) == 25
    assert one(A.intron_length(A.intron_chain(F.col("exons")))) == 20
    assert one(A.merged_chain(F.col("a"), F.col("b"))) == [1, 2, 5, 9, 12, 14] and one(A.merged_chain(F.col("a"), F.array(F.lit(2), F.lit(6)))) is None
    assert one(A.consecutive_offsets(F.col("a"), F.col("c"))) == [1] and one(A.consecutive_offsets(F.col("c"), F.col("a"))) == []
    lit = lambda *x: F.array(*(F.lit(v) for v in x))
    cases = {"identical": ((1, 2), (1, 2)), "apart_left": ((1, 2), (5, 6)), "apart_right": ((5, 6), (1, 2)), "contains": ((1, 2, 3), (2, 3)), "contained": ((2, 3), (1, 2, 3)), "extends_left": ((1, 2, 3), (2, 3, 4)), "extends_right": ((2, 3, 4), (1, 2, 3)), "nested": ((4, 5), (1, 9)), "nesting": ((1, 9), (4, 5)), "conflicting": ((1, 3, 5), (2, 3, 9))}
    for name, (a, b) in cases.items():
        assert one(A.relation(lit(*a), lit(*b))) == name


def test_chain_counts_junctions_and_merging(spark):
    df = spark.createDataFrame([(1, [10, 20], "+"), (1, [10, 20], None), (1, [10, 20, 30, 40], "-"), (1, [], "+")], "b int, chain array<int>, xs string")
    counts = C.chain_counts(df, ["b"])
    assert rows(counts, "chain", "c0", "c1", "c2") == [([], 0, 1, 0), ([10, 20], 1, 1, 0), ([10, 20, 30, 40], 0, 0, 1)]
    assert rows(C.junctions(counts, ["b"]), "l", "r", "count", "strand") == [(10, 20, 3, "."), (30, 40, 1, "-")]
    minus = counts.select("b", "chain", *((-F.col(c)).alias(c) for c in ("c0", "c1", "c2")))
    assert C.merge_counts(counts, minus, keys=["b"]).count() == 0


def test_similarity_and_capped_groups(spark):
    df = spark.createDataFrame([(b, p) for b, ps in {1: [1, 2, 3, 4], 2: [3, 4, 5], 3: [9]}.items() for p in ps], "bundle int, p int")
    assert [(i, j, c, round(r, 3)) for i, j, c, r in rows(C.similar_bundles(df, 0.1, 500), "i", "j", "common", "ratio")] == [(1, 2, 2, 0.667)]
    assert C.similar_bundles(df, 0.8, 500).count() == 0
    chain = spark.createDataFrame([("r", k, k + 1, 1.0 - k / 100) for k in range(6)], "region string, i int, j int, ratio double")
    sizes = lambda limit: sorted(x[0] for x in rows(C.capped_groups(chain, ["region"], limit).groupBy("root").count(), "count"))
    assert sizes(100) == [7] and max(sizes(2)) <= 2 + 1 and sum(sizes(2)) == 7


def test_gap_clusters_split_by_each_bound(spark):
    df = spark.createDataFrame([(0, 5), (8, 5), (18, 5), (29, 5), (29, 90)], "a int, b int").withColumn("k", F.lit(1))
    got = {}
    for a, b, c in rows(C.gap_clusters(df, ["k"], ["a", "b"], 10), "a", "b", "cluster"):
        got.setdefault(c, []).append((a, b))
    assert sorted(got.values()) == [[(0, 5), (8, 5), (18, 5)], [(29, 5)], [(29, 90)]]


def test_mates_pair_once_and_profile(spark):
    left = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "q string, pos int")
    right = spark.createDataFrame([("q", 10), ("q", 20)], "q string, pos int")
    assert rows(M.pair(left, right, ["q"], ["pos"]), "pos", "r_pos") == [(1, 10), (2, 20)]
    lengths = spark.range(1, 1001).select(F.col("id").alias("v"), F.lit(1).alias("k"))
    assert rows(M.length_profile(lengths, ["k"], "v"), "total", "low", "median", "high", "ave") == [(1000, 5, 500, 990, 499.5)]
    profiles = spark.createDataFrame([(1, 500, 80), (2, 3, 7)], "id int, evidence int, low int")
    assert rows(M.fallback(profiles, "evidence", 100, ["low"]), "id", "low") == [(1, 80), (2, 80)]


def test_merging_transcripts(spark):
    df = spark.createDataFrame([("c", [10, 20], 0, 5, 30, 1.0, 1.0), ("c", [10, 20], 1, 3, 28, 2.0, 4.0), ("c", [], 0, 100, 200, 1.0, 1.0), ("c", [], 1, 110, 190, 2.0, 2.0)], "chrm string, chain array<int>, sample_id int, start int, end int, cov double, abd double")
    merged = T.merge(df, ["chrm"])
    assert rows(merged, "chain", "start", "end", "cov", "count2") == [([], 100, 200, 2.0, 2), ([10, 20], 3, 30, 3.0, 2)]
    assert rows(T.per_sample(merged.withColumn("samples", F.array(F.lit(-1), F.lit(0))), 7), "sample_id") == [(0,), (0,), (7,), (7,)]


def test_scores(spark):
    df = spark.createDataFrame([("m1", 0.1), ("m1", 0.4), ("m2", 0.1)], "meta_tid string, y_prob double")
    assert [(k, round(v, 6)) for k, v in rows(T.keep_by_mean(df, "meta_tid", "y_prob", 0.2), "meta_tid", "y_prob_mean")] == [("m1", 0.25)]
    near = spark.createDataFrame([("a", [10, 20]), ("b", [12, 23]), ("c", [30, 40])], "id string, chain array<int>").withColumn("k", F.lit(1))
    assert rows(T.components_by_shift(near, ["k"], "chain", 5), "id", "other") == [("a", "b")]


EDGES = "graph int, s long, t long, w double"


def test_bottleneck_and_top_paths(spark):
    df = spark.createDataFrame([(1, 0, 1, 5.0), (1, 1, 3, 2.0), (1, 0, 2, 3.0), (1, 2, 3, 3.0)], EDGES)
    assert rows(G.bottleneck_paths(df), "path", "width") == [([0, 2, 3], 3.0)]
    assert rows(G.top_paths(df), "rank", "path", "bottlenecks") == [(1, [0, 2, 3], [3.0, 3.0]), (2, [0, 1, 3], [2.0, 5.0])]
    assert rows(G.path_counts(df), "n_paths") == [(2.0,)]
    assert [(v, w) for v, w in rows(G.balance(spark.createDataFrame([(1, 0, 1, 4.0), (1, 1, 2, 1.0)], EDGES)), "v", "target")] == [(1, 2.0)]
    assert G.refined(spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 5, 1.0), (1, 0, 2, 1.0), (1, 3, 5, 1.0)], EDGES)).count() == 2


def test_top_paths_equal_enumeration(spark):
    rng = random.Random(2)
    edges = [(1, s, t, float(rng.randrange(1, 9))) for s, t in itertools.combinations(range(7), 2) if rng.random() < 0.7 or t == s + 1]
    w = {(s, t): x for _, s, t, x in edges}
    paths = [(0, *mid, 6) for n in range(6) for mid in itertools.combinations(range(1, 6), n) if all(e in w for e in itertools.pairwise((0, *mid, 6)))]
    best = sorted(paths, key=lambda p: ([-x for x in sorted(w[e] for e in itertools.pairwise(p))[:2]] + [0] * (2 - min(2, len(p) - 1)), len(p), p))
    got = rows(G.top_paths(spark.createDataFrame(edges, EDGES), 1000, 2), "rank", "path")
    low = lambda p: sorted(w[e] for e in itertools.pairwise(p))[:2]
    assert [low(p) for _, p in got[:3]] == [low(p) for p in best[:3]] and len(got) == len(paths)


def test_decomposition_recovers_paths_and_conserves_flow(spark):
    truth = {(0, 1, 3, 5, 6): 10.0, (0, 2, 3, 4, 6): 4.0}
    w = {}
    for p, x in truth.items():
        for e in itertools.pairwise(p):
            w[e] = w.get(e, 0.0) + x
    edges = spark.createDataFrame([(1, s, t, x) for (s, t), x in w.items()], EDGES)
    phases = spark.createDataFrame([(1, [1, 3, 5], 5), (1, [2, 3, 4], 3)], "graph int, path array<long>, n long")
    assert {tuple(p): x for p, x in rows(G.decompose(edges, phases), "path", "weight")} == pytest.approx(truth)
    assert sum(x[0] for x in rows(G.decompose(edges, ratio=0.0), "weight")) == pytest.approx(14.0)
    assert rows(G.greedy_paths(edges), "path", "weight")[0] == ([0, 1, 3, 5, 6], 10.0)


def test_bridges_take_the_first_that_fits(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 300), (1, 3, 200), (2, 1, 10)], "k int, place int, length int")
    assert rows(G.bridges(df, ["k"], ["place"], "length", 80, 500), "k", "place", "choices") == [(1, 2, 2)]


def test_parameters_by_data_type():
    assert for_data_type("ont").min_junction_support == 2 and for_data_type("paired_end").min_bundle_gap == 200
    with pytest.raises(ValueError):
        for_data_type("unknown")


def test_components_of_chains_stars_and_loops(spark):
    from strandloom.operators.components import components

    edges = [(k, k + 1) for k in range(15)] + [(100, k) for k in range(101, 120)] + [(200, 200), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(16)} | {k: 100 for k in range(100, 120)} | {200: 200, 300: 300, 301: 300}


def test_introns_of_empty_and_odd_chains(spark):
    from strandloom.functions import arrays as A

    rows = spark.createDataFrame([([],), ([1, 5],), ([1, 5, 9],)], "c array<int>").select(A.introns(F.col("c")).alias("i")).collect()
    assert [[tuple(x) for x in r.i] for r in rows] == [[], [(1, 5)], [(1, 5)]]


def test_two_spliced_reads_become_a_graph(spark):
    from strandloom.operators import chains, splice

    reads = [(1, "a", 0, 100, [(0, 20), (60, 100)], [20, 60], "+"), (1, "b", 0, 100, [(0, 20), (60, 100)], [20, 60], "+"), (1, "c", 5, 18, [(5, 18)], [], None)]
    df = spark.createDataFrame(reads, "graph long, qname string, pos int, rpos int, exons array<struct<start:int,end:int>>, chain array<int>, xs string")
    found = splice.graph_tables(df, ["graph"], chains.chain_counts(df, ["graph"]), width=16)
    exons = sorted((r.start, r.end, r.ltype, r.rtype, round(r.ave, 3)) for r in found["exons"].collect())
    assert exons == [(0, 20, "start", "left", 2.65), (60, 100, "right", "end", 2.0)]
    assert sorted((r.s, r.t, round(r.w, 3), r.kind, r.strand) for r in found["edges"].collect()) == [(0, 1, 2.65, "source", "."), (1, 2, 2.0, "junction", "+"), (2, 3, 2.0, "sink", ".")]
    paths = {r.qname: r.path for r in splice.read_paths(df, found["vertices"], ["graph"], "qname", 16).collect()}
    assert paths == {"a": [1, 2], "b": [1, 2], "c": [1]}


def test_levels_and_orders_of_graphs_with_any_numbers(spark):
    edges = [(1, 9, 3, 5.0), (1, 3, 7, 2.0), (1, 9, 7, 4.0), (1, 7, 1, 6.0), (2, 5, 4, 1.0), (3, 1, 2, 1.0), (3, 2, 3, 1.0), (3, 3, 2, 1.0), (3, 3, 4, 1.0)]
    df = spark.createDataFrame(edges, "graph int, s long, t long, w double")
    got = {(r.graph, r.v): r.level for r in G.levels(df).collect()}
    assert got == {(1, 9): 0, (1, 3): 1, (1, 7): 2, (1, 1): 3, (2, 5): 0, (2, 4): 1, (3, 1): 0, (3, 2): None, (3, 3): None, (3, 4): None}
    ordered, names = G.in_order(df)
    old = {(r.graph, r.v): r.old for r in names.collect()}
    assert {(r.graph, old[r.graph, r.s], old[r.graph, r.t], r.w) for r in ordered.collect()} == set(edges[:5])
    best = [r for r in G.top_paths(ordered).where("graph = 1").orderBy("rank").collect()]
    assert [[old[1, v] for v in r.path] for r in best] == [[9, 7, 1], [9, 3, 7, 1]]
    assert G.levels(df.limit(0)).collect() == []


def test_laws_find_what_is_wrong_with_paths(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5.0), (1, 1, 2, 5.0), (1, 0, 2, 1.0), (2, 0, 1, 1.0)], "graph int, s long, t long, w double")
    paths = spark.createDataFrame([(1, 0, [0, 1, 2], 4.0), (1, 1, [0, 1, 2], 2.0), (1, 2, [0, 3, 2], 1.0), (1, 3, [0, 1], 1.0)], "graph int, path_id int, path array<bigint>, weight double")
    got = {r.graph: tuple(r)[1:] for r in G.broken_laws(paths, edges, True).collect()}
    assert got == {1: (2, 1, 1, 2), 2: (0, 0, 0, 0)}
    assert {tuple(r)[1:] for r in G.broken_laws(G.decompose(edges), edges, True).collect()} == {(0, 0, 0, 0)}


def test_graphs_are_taken_apart_alike_however_they_are_dealt(spark):
    import random

    rng = random.Random(6)
    edges, phases = [], []
    for g in range(40):
        for s in range(6):
            for t in range(s + 1, 7):
                if t == s + 1 or rng.random() < 0.4:
                    edges.append((f"g{g}", s, t, float(rng.randrange(1, 50))))
        phases += [(f"g{g}", [0, 1, 2], 3), (f"g{g}", [1, 2, 3, 4], 2)]
    e = spark.createDataFrame(edges, "graph string, s long, t long, w double")
    ph = spark.createDataFrame(phases, "graph string, path array<bigint>, n long")
    got = sorted((r.graph, r.path_id, tuple(r.path), round(r.weight, 6)) for r in G.decompose(e, ph).collect())
    want = []
    for g in {x[0] for x in edges}:
        own = sorted(x[1:] for x in edges if x[0] == g)
        want += [(g, k, p, round(w, 6)) for k, (p, w) in enumerate(G.Decomposition(own, {tuple(p): float(n) for h, p, n in phases if h == g}, 0.3).run())]
    assert got == sorted(want) and G.decompose(e.limit(0), ph).collect() == []
