"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and Spark is local (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
        folder = context.getCheckpointDir()
    return folder


# Shuffle files of a write that is over would else stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, unless the session says so itself."""
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, own or "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(CLEANUP)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: it cuts lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
