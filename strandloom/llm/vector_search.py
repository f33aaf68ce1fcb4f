"""Exact top-k inner-product search with vector-approximation files.

Components are whole numbers, floor(scale * x). Candidates are packed into blocks of cells: `CELLS` equal cells a dimension
between the block's least and greatest value, one byte a component. These approximations are written once, and only they meet
the queries, block by block, one task's work for each pair of blocks.

1. The scan of a block's cells gives every candidate a lower and an upper bound of its score. A block passes on its k best
   lower bounds and the candidates whose upper bound reaches the k-th of them.
2. The k-th best lower bound over all blocks is a floor for each query; what cannot reach it is dropped unread.
3. Exact vectors are read in order of the upper bound: the first `READ` of each query first, then those whose upper bound
   still reaches the k-th exact score found. After that the k best are certain.

Of equal vectors only the k + 1 of smallest id are candidates, as no other can be among the k best: however often one vector
stands, it is met a bounded number of times.

Defined cases: vectors that are null, empty, or hold null or non-finite components, take no part; nor does a candidate of
another length than the query. Components and scores are 64-bit numbers; those that would pass 64 bits are outside the
definition, everything below is exact. Ties go to the smaller id. Rows that repeat an id are one row, that of the vector
smallest in order of components; a query never meets its own id. Rows without an id take no part. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import small_side, stored

BLOCK = 8192
QUERY_BLOCK = 2048
TILE = 128
CELLS = 256
READ = 32
SALTS = 16
FEW = 500_000


def whole_vectors(rows: DataFrame, is_query: Column, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v, dim, asked): floor(scale * x) of each component, one row for each id that takes part."""
    own = rows.select(F.col(key).cast("long").alias("id"), is_query.alias("asked"), F.col(vector).alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    x = F.col("x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = own.where((F.size(x) > 0) & ~bad).select("id", "asked", F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))
    return whole.groupBy("id").agg(F.min("v").alias("v"), F.max(F.coalesce("asked", F.lit(False))).alias("asked")).withColumn("dim", F.size("v"))


def first_of_equals(vectors: DataFrame, most: int) -> DataFrame:
    """The `most` smallest ids of each vector, salted first so that no task orders all copies of one."""
    salted = Window.partitionBy("v", "_salt").orderBy("id")
    some = vectors.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= most).drop("_salt", "_r")


def approximations(exact: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of each vector, and each dimension's first cell's start and cells' width."""
    low, high = exact.min(axis=0), exact.max(axis=0)
    # differences as unsigned numbers: a spread of 2^63 and more stays right
    width = (high.astype(np.uint64) - low.astype(np.uint64)) // np.uint64(cells) + np.uint64(1)
    return ((exact.astype(np.uint64) - low.astype(np.uint64)) // width).astype(np.uint8), low, width.astype(np.int64)


def cell_blocks(candidates: DataFrame, blocks: int) -> DataFrame:
    """(cb, dim, ids, low, width, cells): the approximation file, a block of one length a row."""

    def pack(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        ids = group["id"].combine_chunks().to_numpy()
        order = np.argsort(ids)
        exact = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
        cells, low, width = approximations(exact)
        packed = {"ids": ids[order], "low": low, "width": width, "cells": cells}
        return pa.table({"cb": group["cb"][:1], "dim": group["dim"][:1], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in packed.items()}})

    keyed = candidates.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("cb"))
    return keyed.groupBy("cb", "dim").applyInArrow(pack, "cb int, dim int, ids binary, low binary, width binary, cells binary")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(qb, dim, qids, queries): queries as packed blocks."""

    def pack(group: pa.Table) -> pa.Table:
        packed = {"qids": group["id"].combine_chunks().to_numpy(), "queries": group["v"].combine_chunks().flatten().to_numpy()}
        return pa.table({"qb": group["qb"][:1], "dim": group["dim"][:1], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in packed.items()}})

    keyed = queries.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"))
    return keyed.groupBy("qb", "dim").applyInArrow(pack, "qb int, dim int, qids binary, queries binary")


def bounds(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, k best lower bounds, ids, upper bounds) of one block: the candidates that can be among its k best.

    `ids` ascend. Sums are taken in floating point and widened by more than they can be wrong.
    """
    lower = low.astype(np.float64) + cells * width.astype(np.float64)
    upper = lower + (width - 1)
    largest = np.maximum(np.abs(lower), np.abs(upper)).max(axis=0)
    for at in range(0, len(qids), TILE):
        names, q = qids[at : at + TILE], queries[at : at + TILE].astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        wrong = (np.abs(q) @ largest)[:, None] * (len(low) * 2.0**-50)
        most = up @ upper.T + down @ lower.T + wrong
        least = up @ lower.T + down @ upper.T - wrong
        own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        hit = np.flatnonzero(ids[own] == names)
        most[hit, own[hit]] = least[hit, own[hit]] = -np.inf
        take = min(k, len(ids))
        best = np.partition(least, len(ids) - take, axis=1)[:, len(ids) - take :]
        able = (most >= best[:, :1]) & (most > -np.inf)
        for row, name in enumerate(names.tolist()):
            found = np.flatnonzero(able[row])
            if len(found):
                yield name, best[row][best[row] > -np.inf], ids[found], most[row][found]


def scores(pairs: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(query_id, vec_id, score) of `n` pairs, read exactly."""
    own = vectors.select(F.col("id").alias("vec_id"), "v")
    asked = vectors.where("asked").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    met = own.join(small_side(pairs, n, FEW), "vec_id").join(asked, "query_id").select("query_id", "vec_id", "q", "v")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, v = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                lengths = np.asarray(batch.column(3).value_lengths())
                total = np.add.reduceat(q * v, np.cumsum(lengths) - lengths)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(total, pa.int64())], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(products, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK, read: int = READ) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores over all other rows."""
    vectors = stored(whole_vectors(rows, is_query, key, vector, scale), "vectors")
    n_every, n_query = vectors.agg(F.count("*"), F.count_if("asked")).first()
    nq, nc = max(1, -(-n_query // query_block)), max(1, -(-n_every // block))
    cells = stored(cell_blocks(first_of_equals(vectors, k + 1), nc), "approximations")
    # a pair of blocks is a key of its own, so pairs spread over all tasks; a block's repeats count as nothing in Spark's estimates, so sizes don't choose the join
    left = cells.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = query_blocks(vectors.where("asked"), nq).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    names = ["dim", "qids", "queries", "ids", "low", "width", "cells"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                whole = {x: np.frombuffer(pair[x], np.int64) for x in ("qids", "queries", "ids", "low", "width")}
                own = np.frombuffer(pair["cells"], np.uint8).reshape(-1, pair["dim"])
                found = list(bounds(whole["qids"], whole["queries"].reshape(-1, pair["dim"]), whole["ids"], whole["low"], whole["width"], own, k))
                yield pa.record_batch({
                    "query_id": pa.array([x[0] for x in found], pa.int64()), "lows": pa.array([x[1] for x in found], pa.list_(pa.float64())),
                    "ids": pa.array([x[2] for x in found], pa.list_(pa.int64())), "most": pa.array([x[3] for x in found], pa.list_(pa.float64())),
                })

    met = stored(left.join(right.hint("merge"), ["qb", "cb", "dim"]).select(*names).mapInArrow(scan, "query_id long, lows array<double>, ids array<long>, most array<double>"), "bounds")
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floors = met.select("query_id", F.explode("lows").alias("low")).withColumn("_r", F.row_number().over(by_low)).where(F.col("_r") <= k)
    floors = floors.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("floor"))
    able = met.select("query_id", F.explode(F.arrays_zip("ids", "most")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.most").alias("most"))
    able = able.join(floors, "query_id").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).drop("floor")
    by_most = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    able = stored(able.withColumn("first", F.row_number().over(by_most) <= max(k, read)), "able")
    n_first, n_able = able.agg(F.count_if("first"), F.count("*")).first()
    found = stored(scores(able.where("first").select("query_id", "vec_id"), vectors, n_first), "read")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    if n_able > n_first:
        kth = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", F.col("score").alias("kth"))
        more = able.where("not first").join(kth, "query_id").where(F.col("most") >= F.col("kth")).select("query_id", "vec_id")
        more = stored(more, "unsure")
        found = found.unionByName(scores(more, vectors, more.count()))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
