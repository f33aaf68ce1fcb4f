"""From reads of several samples to transcripts, on hand-made reads."""

import itertools
import math

from pyspark.sql import functions as F

from strandloom.config import Parameters
from strandloom.operators import assembly as A
from strandloom.operators import chains as C
from strandloom.operators import evidence as E
from strandloom.operators import graphs as G
from strandloom.scratch import stored
from strandloom.sources import files

READ = "sample_id int, chrm string, strand string, qname long, exons array<struct<start:int,end:int>>, xs string"
LONG = [(100, 400), (600, 900), (1200, 1500)]
SKIP = [(100, 400), (1200, 1500)]


def reads(spark, plan):
    """`plan`: (sample, chrm, exons, copies)."""
    number = itertools.count()
    data = [(s, c, "+", next(number), x, "+") for s, c, x, n in plan for _ in range(n)]
    rows = spark.createDataFrame(data, READ)
    chain = F.flatten(F.zip_with(F.slice("exons", 1, F.size("exons") - 1), F.slice("exons", 2, F.size("exons")), lambda a, b: F.array(a["end"], b["start"])))
    return rows.select("*", F.when(F.size("exons") > 1, chain).otherwise(F.array().cast("array<int>")).alias("chain"), F.col("exons")[0]["start"].alias("pos"), F.element_at("exons", -1)["end"].alias("rpos"))


def test_two_samples_are_one_group_and_give_both_isoforms(spark, tmp_path):
    df = reads(spark, [(0, "1", LONG, 12), (0, "1", SKIP, 6), (1, "1", LONG, 9), (2, "2", LONG, 5), (1, "1", [(5000, 5400)], 8)])
    found = stored(A.assemble(df, ["chrm", "strand"], width=256), "found")
    chains = {}
    for r in found.collect():
        chains.setdefault((r.chrm, r.sample_id), {})[tuple(r.chain)] = (round(r.cov, 3), r.n_samples, list(r.samples), r.abd)
    long, skip = (400, 600, 900, 1200), (400, 1200)
    assert set(chains["1", -1]) == {long, skip} == set(chains["1", 0])
    assert chains["1", -1][long][1:] == (2, [0, 1], 21.0) and chains["1", -1][skip][1:] == (1, [0], 6.0)
    assert set(chains["1", 1]) == {long, ()}
    assert chains["2", 2] == {long: (5.0, 1, [2], 5.0)} and ("2", -1) not in chains

    merged = stored(A.merged(found, ["chrm", "strand"]), "merged")
    rows = {(r.chrm, tuple(r.chain)): r for r in merged.collect()}
    assert [tuple(x) for x in rows["1", long].exons] == LONG and rows["1", long].kept
    assert set(rows) == {("1", long), ("1", skip), ("1", ()), ("2", long)}
    gtf = A.as_gtf(merged.where("kept"), ["chrm", "strand"], "chrm", "strand")
    lines = [r.value for r in files.gtf_lines(gtf).collect()]
    assert sum("\ttranscript\t" in x for x in lines) == 4 and sum("\texon\t" in x for x in lines) == 3 + 2 + 1 + 3
    A.write_individual(gtf, str(tmp_path / "own"))
    own = {r.sample_id: r.n for r in spark.read.text(str(tmp_path / "own")).groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    assert own == {-1: 4 + 3, 0: 4 + 3, 1: 4 + 2, 2: 4}


def test_samples_say_which_isoforms_go_together(spark):
    a1, a2, c, b1, b2 = (100, 200), (250, 350), (500, 700), (900, 1000), (1100, 1200)
    # no read holds both junctions, and weights alone would pair the ends the other way round
    plan = [(0, "1", [a1, c], 10), (0, "1", [c, b1], 6), (1, "1", [a2, c], 6), (1, "1", [c, b2], 10)]
    found = A.assemble(reads(spark, plan), ["chrm", "strand"], width=256).collect()
    chains = {tuple(r.chain): list(r.samples) for r in found if r.sample_id == -1}
    own, other = (200, 500, 700, 900), (350, 500, 700, 1100)
    assert chains[own] == [0] and chains[other] == [1]
    heavy = [r for r in found if r.sample_id == -1 and tuple(r.chain) in ((200, 500, 700, 1100), (350, 500, 700, 900))]
    assert all(r.cov < min(x.cov for x in found if x.sample_id == -1 and tuple(x.chain) in (own, other)) and r.n_samples == 0 for r in heavy)


def test_merged_edges_keep_common_samples_and_least_amounts(spark):
    schema = "graph int, s long, t long, sample int, a long"
    evidence = spark.createDataFrame([(1, 0, 1, 0, 5), (1, 0, 1, 1, 2), (1, 1, 2, 0, 3), (1, 1, 2, 2, 9), (1, 2, 3, 0, 4), (1, 0, 4, 1, 7)], schema)
    pairs = E.crossings(evidence)
    got = {(r.s, r.v, r.t): (r.n_samples, list(r.samples), r.abundance, round(r.score, 6)) for r in E.merged_support(pairs, evidence).collect()}
    assert got == {(0, 1, 2): (1, [0], 3.0, round(0.99 * 3 + 0.01 * 5, 6)), (1, 2, 3): (1, [0], 3.0, round(0.99 * 3 + 0.01 * 4, 6))}
    first = E.combined(evidence.where("s = 0").withColumnRenamed("t", "v"), evidence.where("s = 1").withColumnRenamed("s", "v"))
    whole = E.combined(first.drop("v").withColumnRenamed("t", "v"), evidence.where("s = 2").withColumnRenamed("s", "v"))
    assert [tuple(r) for r in whole.select("s", "t", "sample", "a").collect()] == [(0, 3, 0, 3)]
    lone = E.merged_support(pairs, evidence.where("sample = 7"))
    assert {(r.n_samples, r.abundance, len(r.samples)) for r in lone.collect()} == {(0, 0.0, 0)}


def test_isolated_edges_take_the_partner_of_the_highest_score(spark):
    edges = spark.createDataFrame([(1, s, t) for s, t in ((0, 2), (1, 2), (2, 3), (2, 4), (2, 5))], "graph int, s long, t long")
    evidence = spark.createDataFrame([(1, 0, 2, 0, 5), (1, 1, 2, 1, 5), (1, 2, 3, 0, 4), (1, 2, 4, 1, 4), (1, 2, 4, 0, 1), (1, 2, 5, 9, 9)], "graph int, s long, t long, sample int, a long")
    none = spark.createDataFrame([], "graph int, path array<bigint>, n long")
    got = {(r.side, r.s, r.t): round(r.confidence, 6) for r in E.isolated_match(edges, none, evidence).collect()}
    score = lambda x, y: 0.99 * min(x, y) + 0.01 * max(x, y)
    assert got == {("in", 0, 3): round(math.log(score(5, 4) / (score(5, 4) + score(5, 1))), 6), ("in", 1, 4): 0.0, ("out", 0, 3): 0.0, ("out", 1, 4): round(math.log(score(5, 4) / (score(5, 4) + score(5, 1))), 6)}
    phased = spark.createDataFrame([(1, [0, 2, 3], 3)], "graph int, path array<bigint>, n long")
    assert {(r.side, r.s, r.t) for r in E.isolated_match(edges, phased, evidence).collect()} == {("in", 1, 4), ("out", 1, 4)}
    assert {tuple(r.path): round(r.n, 6) for r in E.steered(edges, phased, evidence).collect()} == {(0, 2, 3): 3.0, (1, 2, 4): round(score(5, 4), 6)}


def test_mates_are_bridged_over_the_group(spark):
    df = reads(spark, [(0, "1", LONG, 4), (1, "1", [(150, 400), (600, 700)], 2), (1, "1", [(800, 900), (1200, 1350)], 2)])
    df = df.withColumn("mate", F.when(F.col("qname").isin(4, 5), F.col("qname") + 2))
    p = Parameters(insertsize_high=900)
    one = df.withColumn("graph", F.lit("g"))
    found = {r.qname: (list(r.chain), r.pos, r.rpos, [tuple(x) for x in r.exons], r.mate) for r in A.bridge_reads(one, "qname", "mate", p, 256).where("sample_id = 1").collect()}
    whole = ([400, 600, 900, 1200], 150, 1350, [(150, 400), (600, 900), (1200, 1350)], None)
    assert found == {4: whole, 5: whole}
    short = A.bridge_reads(one, "qname", "mate", Parameters(insertsize_high=100), 256)
    assert short.count() == 8


def test_paths_between_equal_enumeration(spark):
    import random

    rng = random.Random(5)
    edges = [(g, s, t, float(rng.randint(1, 9))) for g in (1, 2) for s in range(7) for t in range(s + 1, 8) if rng.random() < 0.5]
    pairs = [(g, s, t) for g in (1, 2, 3) for s in (0, 2, 3) for t in (3, 6, 7)]
    got = {}
    for r in G.paths_between(spark.createDataFrame(edges, "graph long, s long, t long, w double"), spark.createDataFrame(pairs, "graph long, s long, t long"), 1000).collect():
        got.setdefault((r.graph, r.s, r.t), []).append((r.rank, tuple(r.path), tuple(r.bottlenecks)))
    for g, s, t in pairs:
        w = {(a, b): x for h, a, b, x in edges if h == g}
        every = [(s, *m, t) for k in range(t - s) for m in itertools.combinations(range(s + 1, t), k)] if s < t else [(s,)] if s == t else []
        every = [(tuple(sorted(w[e] for e in zip(x, x[1:], strict=False))[:5]), x) for x in every if all(e in w for e in zip(x, x[1:], strict=False))]
        every.sort(key=lambda x: (tuple(-v for v in x[0]), len(x[1]), x[1]))
        assert [(p, low) for _, p, low in sorted(got.get((g, s, t), []))] == [(p, low) for low, p in every]


def test_nothing_in_nothing_out(spark):
    df = reads(spark, [(0, "1", LONG, 1)]).where("qname < 0")
    assert A.assemble(df, ["chrm", "strand"]).count() == 0


def test_groups_of_components_equal_groups_of_all(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (5, 6, 0.5), (6, 7, 0.4)], "i long, j long, ratio double")
    for limit in (2, 3, 100):
        whole = C.capped_groups(pairs.withColumn("k", F.lit(1)), ["k"], limit).select("member", "root").collect()
        assert sorted(map(tuple, C.bundle_groups(pairs, limit).collect())) == sorted(map(tuple, whole))


def test_similarity_by_rare_positions_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = {b: set(rng.sample(range(12), rng.randint(1, 8))) for b in range(40)}
    df = spark.createDataFrame([(b, p) for b, x in sets.items() for p in x], "bundle long, p long")
    for least in (0.1, 0.5, 0.8, 1.0):
        want = {(i, j, len(sets[i] & sets[j])) for i, j in itertools.combinations(sets, 2) if len(sets[i] & sets[j]) >= max(1, least * min(len(sets[i]), len(sets[j])) - 1e-9)}
        assert {(r.i, r.j, r.common) for r in C.similar_bundles(df, least, 100).collect()} == want
    assert Parameters().max_junctions_compared * 2 == 1000


def test_graphs_without_a_path_give_no_row(spark):
    broken = spark.createDataFrame([(1, 0, 1, 5.0), (1, 2, 3, 5.0), (2, 0, 1, 5.0), (2, 1, 2, 5.0)], "graph long, s long, t long, w double")
    phases = spark.createDataFrame([(1, [0, 1], 1)], "graph long, path array<long>, n long")
    for found in (G.decompose(broken), G.decompose(broken, phases), G.greedy_paths(broken), G.top_paths(broken), G.bottleneck_paths(broken)):
        assert [r.graph for r in found.collect()] == [2]


def test_reads_that_share_a_name_have_a_path_each(spark):
    from strandloom.operators import splice as S

    df = reads(spark, [(0, "1", LONG, 3)]).withColumn("graph", F.lit(1))
    tables = S.graph_tables(df, ["graph"], C.chain_counts(df, ["graph"]), width=256)
    mates = reads(spark, [(0, "1", [(150, 400), (600, 700)], 1), (0, "1", [(800, 900), (1200, 1300)], 1), (0, "1", [(150, 400), (600, 700)], 1)]).withColumns({"graph": F.lit(1), "name": F.lit("q")})
    assert sorted(list(r.path) for r in S.read_paths(mates, tables["vertices"], ["graph"], "name", 256).collect()) == [[1, 2], [1, 2], [2, 3]]
    shapes = S.read_shapes(mates, ["graph"], "sample_id")
    seen = S.shape_paths(shapes, tables["vertices"], ["graph"], 256).join(shapes, ["graph", "shape"])
    assert {tuple(r.path): r.n for r in S.phases(seen, ["graph"], 1, "n").collect()} == {(1, 2): 2, (2, 3): 1}
    assert {tuple(r.path) for r in S.phases(seen, ["graph"], 2, "n").collect()} == {(1, 2)}


def test_pairs_by_name_are_bridged_and_overlaps_count_twice(spark):
    df = reads(spark, [(0, "1", LONG, 4), (1, "1", [(150, 400), (600, 700)], 1), (1, "1", [(800, 900), (1200, 1350)], 1), (1, "1", [(100, 300)], 2), (1, "1", [(200, 390)], 1)])
    name = F.when(F.col("qname").isin(4, 5), "pair").when(F.col("qname").isin(6, 7, 8), "three").otherwise(F.col("qname").cast("string"))
    numbered = stored(A.with_mates(df.withColumn("name", name), ["chrm"], "sample_id", "name"), "numbered")
    at = {r._read: r.qname for r in numbered.collect()}
    assert {(r.qname, at[r._mate]) for r in numbered.where("_mate is not null").collect()} == {(4, 5)}
    found = A.assemble(df.withColumn("name", name), ["chrm", "strand"], name="name", p=Parameters(insertsize_high=900, min_transcript_coverage=0.0), width=256).collect()
    assert (400, 600, 900, 1200) in {tuple(r.chain) for r in found if r.sample_id == 1} and {r.path_strand for r in found if r.chain} == {"+"}
    two = reads(spark, [(0, "1", LONG, 2), (0, "1", [(150, 400), (600, 700)], 1), (0, "1", [(650, 900), (1200, 1300)], 1)]).withColumns({"graph": F.lit("g"), "mate": F.when(F.col("qname") == 2, F.lit(3).cast("long"))})
    one = [r for r in A.bridge_reads(two, "qname", "mate", Parameters(insertsize_high=900), 256).collect() if r.pos == 150]
    assert [[tuple(x) for x in r.exons] for r in one] == [[(150, 400), (600, 900), (1200, 1300), (650, 700)]]
