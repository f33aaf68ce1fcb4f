"""Steps of paths are met by stretches of vertices: what they are told, and what is never dealt along with them."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import assembly as A
from strandloom.operators import splice as S
from strandloom.scratch import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    v = [(1, 0, 0, 0, 0.0, -1), *((1, k, 10 * k, 10 * k + (10 if k % 3 else 5), float(k), k // 4) for k in range(1, 200)), (1, 200, 2000, 2000, 0.0, -2)]
    vertices = spark.createDataFrame(v, "graph long, v long, lpos int, rpos int, w double, run long")
    edges = spark.createDataFrame([(1, s, t, float(s % 7 + 1)) for s in range(200) for t in (s + 1, s + 1, s + 2) if t <= 200], "graph long, s long, t long, w double")
    support = spark.createDataFrame([(1, s, s + 1, k, s % 5 + k) for s in range(199) for k in (0, 1, 2) if s % (k + 40) or not k], "graph long, s long, t long, sample int, a long")
    paths = [(1, 1, list(range(60, 70))), (1, 2, [0, 1, 2, 4, 5, 200]), (1, 3, [7]), (1, 4, list(range(100, 200))), (1, 5, [3, 5, 7])]
    return vertices, edges, support, spark.createDataFrame(paths, "graph long, name long, path array<long>")


def test_features_are_those_of_each_step(tables):
    vertices, edges, support, paths = tables
    weight, backing, at = {}, {}, {r.v: r for r in vertices.collect() if r.run >= 0}
    for r in edges.collect():
        weight[r.s, r.t] = weight.get((r.s, r.t), 0.0) + r.w
    for r in support.collect():
        backing.setdefault((r.s, r.t), []).append(r.a)
    want = []
    for p in paths.collect():
        along = [e for e in zip(p.path, p.path[1:]) if e in weight]
        inner = [at[v] for v in p.path if v in at]
        if along:
            w, n, a = [weight[e] for e in along], [len(backing.get(e, ())) for e in along], [sum(backing.get(e, ())) for e in along]
            want.append((p.name, len(along), min(w), max(w), min(n), max(n), min(a), max(a), min(r.w for r in inner), max(r.w for r in inner), sum(r.rpos - r.lpos for r in inner)))
    got = A.path_features(paths, edges, vertices, support, ["graph"], "name", "sample")
    assert sorted((r.name, r.n_edges, r.min_weight, r.max_weight, r.min_samples, r.max_samples, r.min_abundance, r.max_abundance, r.min_v, r.max_v, r.length) for r in got.collect()) == sorted(want)


def test_support_is_of_samples_that_back_every_step(tables):
    _, _, support, paths = tables
    backing = {}
    for r in support.collect():
        backing.setdefault((r.s, r.t), {})[r.sample] = r.a
    want = []
    for p in paths.collect():
        along = [backing.get(e, {}) for e in zip(p.path, p.path[1:])]
        whole = sorted(set.intersection(*map(set, along))) if along else []
        want.append((p.name, len(whole), whole, float(sum(min(x[k] for x in along) for k in whole))))
    got = A.path_support(paths, support, ["graph"], "name", "sample")
    assert sorted((r.name, r.n_samples, list(r.samples), r.abundance) for r in got.collect()) == sorted(want)


def test_exons_of_paths_merge_where_vertices_abut(tables):
    vertices, _, _, paths = tables
    at = {r.v: r for r in vertices.collect() if r.run >= 0}
    want = {}
    for p in paths.collect():
        out = []
        for r in (at[v] for v in p.path if v in at):
            if out and out[-1][1] == r.lpos:
                out[-1] = (out[-1][0], r.rpos)
            else:
                out.append((r.lpos, r.rpos))
        want[p.name] = out
    assert {r.name: [tuple(x) for x in r.exons] for r in S.path_exons(paths, vertices, ["graph"], "name").collect()} == want


def test_steps_carry_neither_their_path_nor_a_second_shuffle(tables):
    vertices, edges, support, paths = tables
    for rows, most in ((A.path_features(paths, edges, vertices, support, ["graph"], "name", "sample"), 2), (S.path_exons(paths, vertices, ["graph"], "name"), 3)):
        moved = [line for line in plan(rows).splitlines() if "Exchange hashpartitioning" in line]
        assert len(moved) <= most
    for rows in (S.on_graph(paths, edges, ["graph"], "name"), A.path_support(paths, support, ["graph"], "name", "sample")):
        assert "_p#" not in plan(rows)


def test_tables_leave_no_shuffle_files_behind(spark, tmp_path):
    from strandloom.scratch import CLEANUP

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    before = count()
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count()
    assert stored(rows, "counted").count() == 1000
    assert spark.conf.get(CLEANUP, None) is None
    left = count()
    rows.write.parquet(str(tmp_path / "plain"))
    assert count() > left and left <= before + 2 * 4
