"""Makes this package importable on the executors of any cluster, whatever their own Python path holds."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


# Rows are long texts at times: batches for Python are bounded by bytes, far below Spark's default, unless the session sets its own bound.
BATCH, UNSET, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1b", 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the session's executors this package, once for each application, and bound its Arrow batches."""
    if spark.conf.get(BATCH, UNSET) == UNSET:
        spark.conf.set(BATCH, str(BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandloom-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


# Spark takes the size of a file for that of its rows and broadcasts a table whose files look small, but positions and types
# are many times smaller in a file than in the driver's memory.
FACTOR, AS_IN_FILE, TIMES = "spark.sql.sources.fileCompressionFactor", 1.0, 32.0


def size_by_rows(spark: SparkSession) -> None:
    """Let what Spark broadcasts unasked be bounded by the size of its rows, unless the session sets a factor of its own."""
    if float(spark.conf.get(FACTOR, str(AS_IN_FILE))) == AS_IN_FILE:
        spark.conf.set(FACTOR, str(TIMES))


# A task holds what it is dealt or reads, and rows are many times larger there than in a shuffle or a file.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", 16 << 20), "spark.sql.files.maxPartitionBytes": ("128MB", 32 << 20)}


def small_tasks(spark: SparkSession) -> None:
    """Let a task be dealt and read a quarter of what Spark aims at, unless the session sets sizes of its own."""
    for name, (unset, most) in TASK_BYTES.items():
        if spark.conf.get(name, unset) == unset:
            spark.conf.set(name, str(most))
