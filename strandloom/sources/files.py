"""Text sources and sinks: sample manifests, profiles, GTF, and feature tables. Files are read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.config import DATA_TYPES

PROFILE_KEYS = {"library_type": "int", "bam_with_xs": "int", "insertsize_low": "int", "insertsize_high": "int", "insertsize_median": "int", "insertsize_ave": "double", "insertsize_std": "double"}

# The 51 columns of a feature table, in file order.
FEATURES = (
    "tid meta_tid chr cov cov2 abundance confidence count1 count2 num_exons gr_vertices gr_edges gr_reads gr_subgraph v e junc_ratio max_mid_exon_len "
    "start_loss1 start_loss2 start_loss3 end_loss1 end_loss2 end_loss3 start_merged_loss end_merged_loss introns intron_ratio start_introns start_intron_ratio "
    "end_introns end_intron_ratio uni_junc seq_min_wt seq_min_cnt seq_min_abd seq_min_ratio seq_max_wt seq_max_cnt seq_max_abd seq_max_ratio "
    "start_cnt start_weight start_abd end_cnt end_weight end_abd unbridge_start_coming_count unbridge_start_coming_ratio unbridge_end_leaving_count unbridge_end_leaving_ratio"
).split()
TEXT_FEATURES = ("tid", "meta_tid", "chr")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, align_file, index_file, protocol, data_type): samples numbered from 0 in file order.

    A manifest is a list made by hand, one line a sample; it is numbered in one task.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    known = F.create_map(*(x for k, v in DATA_TYPES.items() for x in (F.lit(k), F.lit(v))))
    rows = lines.select((F.row_number().over(Window.orderBy("_at")) - 1).alias("sample_id"), parts[0].alias("align_file"), F.get(parts, F.lit(1)).alias("index_file"), F.get(parts, F.lit(2)).alias("protocol"))
    kind = F.try_element_at(known, F.col("protocol"))
    return rows.withColumn("data_type", F.when(kind.isNotNull(), kind).otherwise(F.raise_error(F.concat(F.lit("unknown protocol: "), F.coalesce("protocol", F.lit("none")))).cast("int")))


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row a `<sample_id>.profile` file of "key value" lines; missing keys are null."""
    lines = spark.read.text(f"{folder}/*.profile").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.profile$", 1).cast("int").alias("sample_id"), F.split(F.trim("value"), r"\s+").alias("kv")).where(F.size("kv") == 2)
    return lines.groupBy("sample_id").agg(*(F.max(F.when(F.col("kv")[0] == k, F.col("kv")[1])).cast(kind).alias(k) for k, kind in PROFILE_KEYS.items()))


def profile_lines(profiles: DataFrame) -> DataFrame:
    """(sample_id, value): the lines of each profile, keys that are null left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in PROFILE_KEYS))
    return profiles.select("sample_id", F.explode(pairs).alias("x")).where("x.v is not null").select("sample_id", F.concat_ws(" ", "x.k", "x.v").alias("value"))


def write_by_sample(lines: DataFrame, path: str) -> None:
    """Lines (sample_id, value) as text, a folder for each sample."""
    lines.select("sample_id", "value").write.mode("overwrite").partitionBy("sample_id").text(path)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF items with start made 0-based and attributes as columns."""
    schema = "seqname string, source string, feature string, start int, end int, score double, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")
    value = lambda name: F.nullif(F.regexp_extract("attributes", rf'(?:^|;\s*){name}\s+"?([^";]*)"?', 1), F.lit(""))
    names = ("gene_id", "transcript_id", "gene_type", "transcript_type")
    cov = F.coalesce(*(value(x) for x in ("cov", "coverage", "expression", "expr"))).cast("double")
    return rows.select("seqname", "source", "feature", (F.col("start") - 1).alias("start"), "end", "score", "strand", "frame", *(value(n).alias(n) for n in names), cov.alias("cov"), value("cov2").cast("double").alias("cov2"), value("count").cast("int").alias("count"), value("exon").cast("int").alias("exon"))


def transcripts_of(items: DataFrame) -> DataFrame:
    """(seqname, strand, gene_id, transcript_id, cov, exons): sorted exons of each transcript."""
    exons = items.where("feature = 'exon'").groupBy("seqname", "strand", "gene_id", "transcript_id").agg(F.max("cov").alias("_c"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    cov = items.where("feature = 'transcript'").groupBy("transcript_id").agg(F.max("cov").alias("cov"))
    return exons.join(cov, "transcript_id", "left").select("seqname", "strand", "gene_id", "transcript_id", F.coalesce("cov", "_c").alias("cov"), "exons")


def gtf_lines(transcripts: DataFrame, source: str = "strandloom") -> DataFrame:
    """(seqname, transcript_id, k, value): a transcript line (k = 0) and a line for each exon, starts 1-based."""
    has = lambda name: F.col(name) if name in transcripts.columns else F.lit(None)
    ids = F.format_string('gene_id "%s"; transcript_id "%s";', "gene_id", "transcript_id")
    more = F.concat(ids, F.format_string(' cov "%.4f";', "cov"), F.when(has("cov2").isNotNull(), F.format_string(' cov2 "%.4f";', has("cov2").cast("double"))).otherwise(""), F.when(has("count").isNotNull(), F.format_string(' count "%d";', has("count").cast("long"))).otherwise(""))
    first, last = F.col("exons")[0]["start"], F.element_at("exons", -1)["end"]
    line = lambda kind, a, b, text: F.concat_ws("\t", "seqname", F.lit(source), F.lit(kind), (a + 1).cast("string"), b.cast("string"), F.lit("1000"), "strand", F.lit("."), text)
    head = F.array(F.struct(F.lit(0).alias("k"), line("transcript", first, last, more).alias("value")))
    body = F.transform("exons", lambda x, i: F.struct((i + 1).alias("k"), line("exon", x["start"], x["end"], F.concat(ids, F.format_string(' exon "%d";', i + 1))).alias("value")))
    return transcripts.select("seqname", "transcript_id", F.explode(F.concat(head, body)).alias("x")).select("seqname", "transcript_id", "x.k", "x.value")


def write_gtf(transcripts: DataFrame, path: str) -> None:
    """One GTF in (seqname, transcript, exon) order, as range-partitioned part files that concatenate in name order."""
    gtf_lines(transcripts).orderBy("seqname", "transcript_id", "k").select("value").write.mode("overwrite").text(path)


def feature_schema() -> str:
    whole = {"count1", "count2", "num_exons", "gr_vertices", "gr_edges", "gr_reads", "gr_subgraph", "v", "e", "introns", "start_introns", "end_introns", "uni_junc", "seq_min_cnt", "seq_max_cnt", "start_cnt", "end_cnt", "unbridge_start_coming_count", "unbridge_end_leaving_count"}
    return ", ".join(f"`{c}` {'string' if c in TEXT_FEATURES else 'int' if c in whole else 'double'}" for c in FEATURES)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=feature_schema())


def write_features(rows: DataFrame, path: str) -> None:
    """Tab-separated, no header, two decimals."""
    kinds = dict(rows.dtypes)
    rows.select(*(F.format_string("%.2f", c).alias(c) if kinds[c] == "double" else F.col(c) for c in FEATURES)).write.mode("overwrite").csv(path, sep="\t", header=False)


def tsv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value): the columns joined by tabs, doubles with two decimals."""
    kinds = dict(rows.dtypes)
    return rows.select(F.concat_ws("\t", *(F.format_string("%.2f", c) if kinds[c] == "double" else F.col(c).cast("string") for c in columns)).alias("value"))
