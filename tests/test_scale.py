"""What keeps the driver's and the tasks' memory bounded as tables grow."""

from pyspark.sql import functions as F

from strandloom.scratch import stored
from strandloom.sources.tables import table


def test_small_files_of_many_rows_are_not_broadcast(spark):
    table(spark, "/root/testdata/sf0.001", "lineitem")
    side = F.when(F.col("id") % 3 == 0, "left").otherwise("right")
    many = stored(spark.range(600_000).select(F.floor(F.col("id") / 9).alias("graph"), F.col("id").alias("v"), side.alias("ltype")), "many")
    plan = many.join(many.select("graph", F.col("v").alias("w")), "graph")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_sets_are_compared_with_few_shuffles(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["overlap_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) <= 8


SMALL = "/root/testdata/sf0.001"


def shuffles(df):
    return sum("Exchange hashpartitioning" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_spliced_reads_take_one_shuffle(spark):
    from strandloom.sources.tables import spliced

    assert shuffles(spliced(spark, SMALL)) == 1


def test_lines_join_to_exons_where_they_touch(spark):
    from strandloom.functions.arrays import joined

    df = spark.createDataFrame([(1, [(0, 5), (5, 9), (6, 7), (8, 12), (14, 15)]), (2, [(3, 4)]), (3, [(None, None), (1, 2)]), (4, [(None, None)])], "id int, x array<struct<start:int,end:int>>")
    got = {r.id: [tuple(x) for x in r.e] for r in df.select("id", joined(F.col("x")).alias("e")).collect()}
    assert got == {1: [(0, 12), (14, 15)], 2: [(3, 4)], 3: [(1, 2)], 4: [(None, None)]}


def test_gap_clusters_deal_rows_once_a_bound(spark):
    import __spark_entry__ as entry

    assert shuffles(entry.queries()["gap_clusters"](spark, SMALL)) <= 16


def test_unique_junctions_are_counted_without_a_join(spark):
    from strandloom.operators.transcripts import unique_junctions

    df = spark.createDataFrame([(1, 7, 0, 1), (1, 7, 0, 1), (1, 7, 1, 2), (1, 8, 1, 2), (1, 8, 2, 3), (2, 9, 1, 2), (1, 5, 1, 2)], "g int, p int, l int, r int")
    found = unique_junctions(df, ["g"], "p", ["l", "r"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 5, 0), (1, 7, 1), (1, 8, 1), (2, 9, 1)]


def test_tasks_are_dealt_less_than_spark_would(spark):
    table(spark, SMALL, "lineitem")
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").rstrip("b")) <= 16 << 20
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) <= 32 << 20


def test_samples_of_merged_items_are_told_once_before_they_are_gathered(spark):
    from strandloom.operators.transcripts import merge

    rows = [("1", [1, 2], 7, 3, 9, 1.0, 5), ("1", [1, 2], 7, 2, 9, 2.0, 4), ("1", [1, 2], 8, 3, 12, 4.0, 1), ("1", [1, 2], None, 3, 10, 8.0, 2), ("2", [], 7, 0, 100, 1.0, 1), ("2", [], 9, 5, 100, 3.0, 2)]
    found = merge(spark.createDataFrame(rows, "chrm string, chain array<int>, sample_id int, start int, end int, cov double, abd int"), ["chrm"])
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.chrm, r.chain, r.start, r.end, r.cov, r.abd, r.count2, r.samples) for r in found.collect())
    assert got == [("1", [1, 2], 2, 12, 15.0, 5, 2, [7, 8]), ("2", [], 0, 100, 3.0, 2, 2, [7, 9])]
