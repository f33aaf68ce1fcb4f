"""The tables at hand, and the declared mapping of lineitem and events onto reads, chains and paths.

It is a proxy that lets every operator be checked against SQL, not biology: a lineitem is a read of sample l_suppkey
on chromosome l_returnflag, strand + where l_linestatus is O, from the ship day (counted from 1990) over l_quantity
positions; an order's chain is its sorted distinct parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.shipping import ship, size_by_rows, small_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    size_by_rows(spark)
    small_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("chrm"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        pos.alias("pos"), (pos + F.col("l_quantity").cast("int")).alias("rpos"), F.round(F.col("l_tax") * 100).cast("int").alias("qual"),
        F.col("l_orderkey").alias("qname"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
    )


READS_SQL = """reads AS (SELECT l_suppkey AS sample_id, l_returnflag AS chrm, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
  date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER AS pos, (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INTEGER)::INTEGER AS rpos,
  round(l_tax * 100)::INTEGER AS qual, l_orderkey AS qname, l_partkey AS part, l_linenumber AS line, l_extendedprice AS price, l_quantity AS quantity FROM lineitem)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, chain): each order's sorted distinct parts."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("bundle")).agg(F.array_sort(F.collect_set("l_partkey")).alias("chain"))


CHAINS_SQL = "chains AS (SELECT l_orderkey AS bundle, list_sort(list_distinct(list(l_partkey))) AS chain FROM lineitem GROUP BY 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, at, event_id, event_type, value): at is whole seconds."""
    return table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type", "value")


EVENTS_SQL = "ev AS (SELECT user_id, floor(epoch(ts))::BIGINT AS \"at\", event_id, event_type, value FROM events)"


def spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qname, graph, exons, chain, pos, rpos): an order as one spliced read, its few lines merged to disjoint exons in one shuffle."""
    from strandloom.functions.arrays import intron_chain, joined

    lines = reads(spark, sf_dir).groupBy("qname").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), F.col("rpos").alias("end")))).alias("_lines"))
    rows = lines.select("qname", joined(F.col("_lines")).alias("exons"))
    return rows.select("qname", F.floor(F.col("qname") / 100).alias("graph"), "exons", intron_chain(F.col("exons")).alias("chain"), F.col("exons")[0]["start"].alias("pos"), F.element_at("exons", -1)["end"].alias("rpos"))


SPLICED_SQL = f"""{READS_SQL}, blk_f AS (SELECT *, CASE WHEN pos > max(rpos) OVER (PARTITION BY qname ORDER BY pos, rpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM reads),
blk_g AS (SELECT *, sum(nw) OVER (PARTITION BY qname ORDER BY pos, rpos ROWS UNBOUNDED PRECEDING) AS g FROM blk_f),
blk AS (SELECT qname, min(pos)::INTEGER AS s, max(rpos)::INTEGER AS e FROM blk_g GROUP BY qname, g),
sp0 AS (SELECT qname, floor(qname / 100)::BIGINT AS graph, list({{'s': s, 'e': e}} ORDER BY s) AS x, min(s) AS pos, max(e) AS rpos FROM blk GROUP BY 1),
sp AS (SELECT *, flatten(list_transform(range(1, len(x)), lambda i: [x[i].e, x[i + 1].s])) AS chain FROM sp0)"""
