"""From a manifest of alignment files to GTF files: one merged, and one a sample.

    from strandloom.run import assemble_manifest
    assemble_manifest(spark, "samples.list", "/shared/out")

or `python -m strandloom.run samples.list /shared/out`, with any field of `Parameters` as `--field value`.
"""

from __future__ import annotations

import json
import sys
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import Parameters
from strandloom.functions.arrays import exons_of
from strandloom.operators import assembly as A
from strandloom.operators import mates as M
from strandloom.operators import reads as R
from strandloom.operators.intervals import BIN
from strandloom.scratch import stored
from strandloom.shipping import ship
from strandloom.sources import bam, files
from strandloom.sources.sample_files import write_files

KEYS = ["chrm", "bundle_strand"]
MERGED_NAME = "merged"


def sample_reads(spark: SparkSession, manifest: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Accepted reads of all files of a manifest, with sample_id, exons, chain, and the strand of the bundle they belong to.

    A sample's library comes from its spliced reads: where most strand tags agree with the flags one way, the flags give the strand.
    """
    ship(spark)
    bam.register(spark)
    listed = manifest.select("sample_id", "align_file").collect()  # a list made by hand, one line a sample
    paths = spark.createDataFrame([(r.sample_id, r.align_file) for r in listed], "sample_id int, path string")
    every = spark.read.format("alignments").option("paths", json.dumps([r.align_file for r in listed])).load()
    own = stored(R.accepted(R.project(every), p).join(F.broadcast(paths), "path").drop("path"), "alignments")  # one row a sample
    votes = own.where("spliced and xs is not null").withColumn("first", R.library_strand(F.lit("FR_FIRST")) == F.col("xs"))
    library = M.library_type(votes, ["sample_id"], "first").select("sample_id", "library")
    found = own.join(library, "sample_id", "left").withColumn("strand", F.when(F.col("library") != "UNSTRANDED", R.library_strand(F.col("library"))))
    return R.routed(found).withColumn("exons", exons_of(F.col("chain"), F.col("pos"), F.col("rpos")))


def assemble_manifest(spark: SparkSession, manifest: str, out: str, p: Parameters = Parameters(), width: int = BIN) -> DataFrame:
    """Writes `<out>/merged.gtf` and `<out>/<sample>.gtf` for each sample of the manifest; returns the merged transcripts.

    The file numbered by the count of samples holds what only the graph of all samples has.
    """
    samples = stored(files.read_manifest(spark, manifest), "manifest")
    reads = stored(sample_reads(spark, samples, p), "reads")
    found = stored(A.assemble(reads, KEYS, name="qname", p=p, width=width), "transcripts")
    merged = stored(A.merged(found, KEYS, p=p), "merged")
    gtf = stored(A.as_gtf(merged.where("kept"), KEYS, "chrm", "bundle_strand"), "gtf")
    order = ["seqname", "transcript_id", "k"]
    write_files(files.gtf_lines(gtf).withColumn("name", F.lit(MERGED_NAME)), out, ".gtf", order, spark.createDataFrame([(MERGED_NAME,)], "name string"))
    n = samples.count()
    own = A.individual_lines(gtf).withColumn("name", F.when(F.col("sample_id") == A.MERGED, n).otherwise(F.col("sample_id")))
    write_files(own, out, ".gtf", order, samples.select(F.col("sample_id").alias("name")).unionByName(spark.createDataFrame([(n,)], "name int")))
    return merged


def main(arguments: list[str]) -> None:
    kinds = {f.name: type(f.default) for f in fields(Parameters)}
    manifest, out, *rest = arguments
    given = {}
    for flag, value in zip(rest[::2], rest[1::2], strict=True):
        name = flag.removeprefix("--")
        if name not in kinds:
            raise SystemExit(f"unknown parameter: {flag}")
        given[name] = value.lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value)
    spark = SparkSession.builder.getOrCreate()
    assemble_manifest(spark, manifest, out, replace(Parameters(), **given))


if __name__ == "__main__":
    main(sys.argv[1:])
