"""The corpus pipeline: language identification, near-duplicate removal, decontamination, mixing, sharding.

Each stage reads all that its predecessor kept and returns rows with the columns of `documents` (the last returns the
shard of each row instead of its text). Rows go by a stage's decision only:

- language: documents in no learned language (no letter, or unlike every profile) go;
- near-duplicates: of each group of five-word Jaccard 0.8 links the smallest doc_id stays;
- decontamination: documents that hold a benchmark item go;
- mixing: each document is there as often as the mix takes it, at most three times;
- sharding: every row gets a shard and a slot.

Defined cases are those of the operators. Stages decide row by row: where a doc_id is null or repeated each row gets a
number for the stage, in order of doc_id (nulls last), so rows of one doc_id and several texts, and rows without one, are
judged by their own text. Rows that repeat a doc_id and text become one at near-duplicates; rows without a doc_id and
without words stay. Empty tables give empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, language_id, mixing, ngram_jaccard, sharding
from strandloom.llm.common import held_out, identified, small_side, stored, table
from strandloom.shipping import ship

LEAST_SCORE = 0.25
SHARDS = 40
FEW = 1_000_000
ROW = "_row_number"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    profiles = language_id.trained_on(docs, held_out(F.col("doc_id")))
    names = docs.columns
    plain = docs.toDF(*(c if c == "text" else f"_{k}" for k, c in enumerate(names)))  # whatever the columns are called
    found = language_id.identify(plain, profiles)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*plain.columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, unique = identified(docs, "doc_id", ROW)
    found = stored(ngram_jaccard.components(rows.select(F.col(ROW).alias("doc_id"), "text"), ngram_jaccard.NEAR_WORDS, *ngram_jaccard.NEAR), "near").withColumnRenamed("doc_id", ROW)
    gone = found.where(F.col(ROW) != F.col("component_id")).select(ROW)
    if not unique:  # rows without words link with nothing: of those that repeat a doc_id and text the first stays
        empty = found.where("n_shingles = 0").select(ROW)
        bare = rows.where("doc_id is not null").join(empty, ROW, "left_semi").select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.col("text").isNull().alias("_null"))
        first = bare.groupBy("doc_id", "_text", "_null").agg(F.min(ROW).alias(ROW))
        gone = stored(gone.unionByName(bare.select(ROW).join(first.select(ROW), ROW, "left_anti")), "gone")
    return rows.join(small_side(gone, gone.count(), FEW), ROW, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = identified(docs, "doc_id", ROW)
    leaked = stored(decontamination.contained_items(rows, table(spark, sf_dir, "benchmark"), key=ROW).select(F.col("doc_id").alias(ROW)).distinct(), "leaked")
    return rows.join(small_side(leaked, leaked.count(), FEW), ROW, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, _ = identified(docs, "doc_id", ROW)
    taken = mixing.mix(rows.select(ROW, "doc_id", "source", "text")).where("taken > 0")
    times = stored(taken.select(ROW, (F.col("taken") / F.col("size")).cast("int").alias("_times")), "times")
    repeated = rows.join(small_side(times, times.count(), FEW), ROW)
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None  # rank profiles and the knapsack have no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
