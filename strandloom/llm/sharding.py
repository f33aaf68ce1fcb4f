"""Contiguous shards of near equal bytes, from global prefix sums of per-cell totals.

Documents are ordered by a hash of their text (equal texts lie together) and doc_id. The order is cut into cells:
ranges of the hash, and for a text with very many copies (there are fewer than `HOT_PARTS` such texts) slices of it by a
hash of doc_id, both about `CELL_ROWS` rows each. Each cell's bytes and rows are summed where they lie; a prefix sum over the
cell totals gives every cell its start, and a running sum inside the cell gives every document its place. A document
goes to the shard that holds the middle of its bytes; texts whose copies together weigh at most 1 / `WHOLE` of a
shard go together, to the shard that holds their common middle. No task holds more than a cell.

Defined cases: a null text weighs only the overhead, and its crc32 is null. An empty table gives no rows. Rows that
agree in text and doc_id are ordered by nothing further and may take each other's slot. Extra columns but the text are kept,
those of the result's names replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import small_side, stored

OVERHEAD = 16
CELL_ROWS = 1 << 14
CELL_BITS, MOST_BITS = 10, 18
HOT_PARTS = 4096
FEW = 1_000_000
WHOLE = 20


def shard_by_bytes(documents: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`documents` without its text, with size, text_crc32, law, shard, slot and grown_shard.

    The text is read once; what is ordered and summed is a few numbers a document.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    columns = [c for c in documents.columns if c != text and c not in made]
    raw = F.col(text).cast("binary")
    own = documents.select(
        F.struct(*columns).alias("_row"),
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + OVERHEAD).alias("_size"),
        F.crc32(raw).alias("_crc"),
        F.xxhash64(raw).alias("_h"),
    )
    rows = stored(own, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    # a text with more than 1 / HOT_PARTS of the rows: fewer than HOT_PARTS of them exist
    slices = F.ceil(F.col("c") / F.lit(float(CELL_ROWS))).cast("int")
    hot = rows.groupBy("_h").agg(F.count("*").alias("c")).where(F.col("c") > max(1000, n // HOT_PARTS)).select("_h", slices.alias("_hot"))
    bits = max(CELL_BITS, min(MOST_BITS, (n // CELL_ROWS).bit_length()))
    celled = rows.join(F.broadcast(hot), "_h", "left").select(
        "*",
        F.shiftrightunsigned("_h", 64 - bits).alias("_cell"),
        F.when(F.col("_hot") > 0, F.col("_h")).otherwise(0).alias("_hk"),
        F.when(F.col("_hot") > 0, F.pmod(F.xxhash64(F.lit("slice"), "_key"), "_hot") + 1).otherwise(0).alias("_hs"),
    )
    cells = celled.groupBy("_cell", "_hk", "_hs").agg(F.sum("_size").alias("_b"), F.count("*").alias("_r"))
    # the prefix sum runs over one row a cell: at most 2^MOST_BITS of them, and the slices of hot texts
    before = Window.orderBy("_cell", "_hk", "_hs").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_cell", "_hk", "_hs", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"), "_b")
    # the slices of a hot text follow each other: its copies' common bytes
    whole = Window.partitionBy("_cell", "_hk")
    starts = starts.withColumns({"_h0": F.min("_b0").over(whole), "_h1": F.max(F.col("_b0") + F.col("_b")).over(whole)}).drop("_b")
    starts = stored(starts, "cells")
    placed = celled.join(small_side(starts, starts.count(), FEW), ["_cell", "_hk", "_hs"])
    cell = Window.partitionBy("_cell", "_hk", "_hs").orderBy("_h", "_key", "_size")
    run = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copies = Window.partitionBy("_cell", "_hk", "_hs", "_h")
    at = placed.withColumns({"_end": F.col("_b0") + F.sum("_size").over(run), "_rank": F.col("_r0") + F.row_number().over(cell) - 1})
    at = at.withColumn("_start", F.col("_end") - F.col("_size")).withColumns({"_g0": F.when(F.col("_hs") > 0, F.col("_h0")).otherwise(F.min("_start").over(copies)), "_g1": F.when(F.col("_hs") > 0, F.col("_h1")).otherwise(F.max("_end").over(copies))})
    together = F.col("_g1") - F.col("_g0") <= F.lit(total / shards / WHOLE)
    middle = F.when(together, (F.col("_g0") + F.col("_g1")) / 2).otherwise((F.col("_start") + F.col("_end")) / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards / max(1, total)))).cast("int")
    cut = stored(at.select("_row", "_size", "_crc", shard.alias("shard"), "_rank"), "shards")
    firsts = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "_row.*",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
