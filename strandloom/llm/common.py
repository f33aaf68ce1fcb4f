"""What the corpus operators share: tables, the shared scratch folder, and views of Arrow text as bytes."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model here learns from; rows without doc_id are of it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
        folder = context.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(df: DataFrame, key: str, name: str, text: str = "text") -> tuple[DataFrame, bool]:
    """`df` with a column `name` that tells its rows apart and ascends with `key` (nulls last), and whether `key` did.

    Where `key` is null or repeated somewhere the rows are sorted, numbered and stored once.
    """
    rows, keys = df.agg(F.count("*"), F.count_distinct(key)).first()
    if rows == keys:
        return df.withColumn(name, F.col(key).cast("long")), True
    ordered = df.orderBy(F.col(key).asc_nulls_last(), F.xxhash64(text))
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), "identified"), False


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a join side whose counted `rows` are within `limit`; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, whose keys are unique: those marked `hot` by broadcast, the rest by a shuffle.

    The caller sees to it that `hot` holds for a bounded number of keys (such as shares of all rows above a limit), which
    are those that would gather too many rows of `left` in one task. Both are read twice: give stored tables.
    """
    frequent, rare = right.where(hot), right.where(~hot)
    apart = left.join(F.broadcast(frequent.select(*on)), on, "left_anti")
    return left.join(F.broadcast(frequent), on).unionByName(apart.join(rare, on, how))


def give_back() -> None:
    """Freed memory goes back to the machine: Python workers live on between tasks, and an executor pays for what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidied(work: Callable) -> Callable:
    """A function over batches (a generator) or over a group that gives freed memory back when it ends."""

    @functools.wraps(work)
    def batches(given):
        try:
            yield from work(given)
        finally:
            give_back()

    @functools.wraps(work)
    def group(given):
        try:
            return work(given)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(work) else group


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans get equal hashes wherever they lie."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def spans(inside: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` bytes that stay in one row (and of one `kind`): starts, ends, and their rows."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] if kind is None else ~inside[:-1] | (kind[1:] != kind[:-1])
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = inside[firsts]
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:-1] = inside[:-1] & (begin[1:] | ~inside[1:])
    stop[n] = inside[n - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop), np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes outside space and 0x09-0x0D: starts, ends, rows."""
    return spans(~_SPACE[data], offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its sorted distinct `size`-word shingles, A-Z lower-cased, as 63-bit hashes.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    data = lowered(data)
    starts, ends, rows = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + mixed(hashes[k : k + len(joined)] + np.uint64(k + 1))
    joined = (mixed(joined) >> np.uint64(1)).astype(np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            one = b - a
            for h in hashes[a:b].tolist():
                one = (one * 0xA0761D6478BD642F + h) & 0xFFFFFFFFFFFFFFFF
            out.append((mixed(np.array([one], np.uint64)) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
