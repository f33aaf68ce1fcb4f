"""Carried states against plain folds, single exons that fall together, and keys that hold all rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import carry
from strandloom.operators import chains as C
from strandloom.operators import intervals as I
from strandloom.operators import reads as R
from strandloom.operators import transcripts as T

ROW = "k string, p int, q int, id int"


def made(seed, n=300, keys=("a", None), most=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.randrange(-50, most)
        out.append((rng.choice(keys), p, p + rng.randrange(1, 60), i))
    return out


def in_order(rows):
    return itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])), key=lambda r: r[0])


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_carried_values_are_those_of_one_walk(spark, width):
    rows = made(1)
    df, order = spark.createDataFrame(rows, ROW), ["p", "q", "id"]
    found = carry.previous(df, ["k"], order, {"id": "before"}, width, "there")
    found = carry.following(found, ["k"], order, {"id": "after"}, width)
    found = carry.running(found, ["k"], order, "q", "total", "sum", True, width)
    found = carry.running(found, ["k"], order, "q", "far", "max", False, width)
    got = {r.id: (r.before, r.there, r.after, r.total, r.far) for r in found.collect()}
    for _, group in in_order(rows):
        own = list(group)
        for i, r in enumerate(own):
            before, after = own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None
            assert got[r[3]] == (before and before[3], before is not None, after and after[3], sum(x[2] for x in own[: i + 1]), max((x[2] for x in own[:i]), default=None))


@pytest.mark.parametrize("width", [5, 64, 10_000])
def test_islands_runs_and_segments_equal_plain_walks(spark, width):
    rows = made(2, 200, most=3000)
    df = spark.createDataFrame(rows, ROW)
    want, of = [], {}
    for key, group in in_order(rows):
        own = list(group)
        start, end, n = own[0][1], own[0][2], 0
        members = []
        for r in own:
            if r[1] > end + 3:
                want.append((key, start, end, n))
                of |= {i: (start, end) for i in members}
                start, end, n, members = r[1], r[2], 0, []
            end, n = max(end, r[2]), n + 1
            members.append(r[3])
        want.append((key, start, end, n))
        of |= {i: (start, end) for i in members}
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in I.merge_islands(df, ["k"], "p", "q", 3, width).select("k", "start", "end", "n").collect())
    assert {r.id: (r.island_start, r.island_end) for r in I.assign_islands(df, ["k"], "p", "q", 3, width).collect()} == of
    kept = {r.id for r in R.drop_runs(df, ["k"], ["p", "q", "id"], ["p"], width).collect()}
    cut = {(r.k, r.start, r.end) for r in I.segments(df, ["k"], "p", width).collect()}
    for key, group in in_order(rows):
        own = list(group)
        assert {r[3] for r in own} & kept == {r[3] for i, r in enumerate(own) if not i or own[i - 1][1] != r[1]}
        points = sorted({r[1] for r in own})
        assert {(a, b) for k, a, b in cut if k == key} == set(itertools.pairwise(points))


def test_clusters_by_gaps_do_not_depend_on_bins(spark):
    df = spark.createDataFrame(made(3, 150, most=4000), ROW)
    whole = {r.id: r.cluster for r in C.gap_clusters(df, ["k"], ["p", "q"], 10, 1 << 20).collect()}
    assert {r.id: r.cluster for r in C.gap_clusters(df, ["k"], ["p", "q"], 10, 32).collect()} == whole and len(set(whole.values())) > 20


def test_one_key_with_all_rows_is_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("a").alias("k"), (F.col("id") * 3).cast("int").alias("p"), (F.col("id") * 3 + 2).cast("int").alias("q"), F.col("id").cast("int").alias("id")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = carry.previous(df, ["k"], ["p", "q"], {"q": "before"}, 1000)
        shares = [r.n for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(shares) < 30_000


def runs(intervals, least):
    """The walk that overlap_runs stands for."""
    out, first, far = [], None, None
    for s, e in sorted(set(intervals)):
        shared = 0 if far is None else min(far, e) - s
        if far is None or not (shared >= least * (e - s) or shared >= least * (far - first)):
            out.append([])
            first, far = s, s
        far = max(far, e)
        out[-1].append((s, e))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_single_exons_fall_together_as_in_one_walk(spark, seed):
    rows = made(seed, 250, ("a", None, "b"), 150 + 1000 * seed)
    rows += [("c", 0, 100, 1000), ("c", 10, 300, 1001), ("c", 250, 320, 1002), ("c", 400, 410, 1003)]
    df = spark.createDataFrame(rows, ROW).select("k", F.col("p").alias("start"), F.col("q").alias("end"))
    got = {}
    for r in T.overlap_runs(df, ["k"], 0.8, 50).collect():
        got.setdefault((r.k, r.run), set()).add((r.start, r.end))
    for key in ("a", None, "b", "c"):
        want = runs([r[1:3] for r in rows if r[0] == key], 0.8)
        assert sorted(map(sorted, (v for (k, _), v in got.items() if k == key))) == sorted(map(sorted, want))


def test_neighbours_without_overlap_stay_apart(spark):
    schema = "chrm string, chain array<int>, sample_id int, start int, end int, cov double, abd double"
    rows = [("1", [], 0, 100, 300, 2.0, 1.0), ("1", [], 1, 110, 310, 3.0, 2.0), ("1", [], 1, 400, 600, 4.0, 1.0), ("1", [], 2, 120, 180, 9.0, 1.0), ("1", [5, 9], 0, 1, 20, 1.0, 1.0), ("1", [5, 9], 1, 2, 30, 2.0, 3.0)]
    got = sorted((list(r.chain), r.start, r.end, r.cov, r.abd, r.count2, list(r.samples)) for r in T.merge(spark.createDataFrame(rows, schema), ["chrm"]).collect())
    assert got == [([], 100, 310, 9.0, 2.0, 3, [0, 1, 2]), ([], 400, 600, 4.0, 1.0, 1, [1]), ([5, 9], 1, 30, 3.0, 3.0, 2, [0, 1])]
    loose = T.merge(spark.createDataFrame(rows, schema), ["chrm"], least=0.96).where(F.size("chain") == 0)
    assert loose.count() == 2 + 1 and T.merge(spark.createDataFrame([], schema), ["chrm"]).collect() == []
