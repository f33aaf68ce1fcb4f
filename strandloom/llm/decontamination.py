"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased and cut into words (runs of letters and digits); shingles are five words, or all the words
of a test item that has fewer. An item is found in a document that holds at least `least` of its distinct shingles.

Items are partitioned by their number of shingles, doubling. Each partition keeps of every item the smallest
MinHash values, as many as the partition's largest item could miss and still be found, plus one: a document that
holds `least` of an item's shingles then holds one of its kept values, so the search loses nothing. Documents of
any length look up all their shingle hashes among these values; every pair met is verified on the shingles' words.

All steps are DataFrame functions. The side that is looked up is the benchmark's sketch, broadcast only when its
counted rows are few.

Defined cases: null and wordless texts and items match nothing. Rows with one doc_id (or item_id) count as one
document (item): their shingles are put together. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import small_side, stored

WORDS = 5
LEAST = 0.8
FEW = 200_000


def word_list(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _windows(words: str, width: int, joined) -> Column:
    """`joined` of every `width` neighbours of the array column `words`."""
    own = F.col(words)
    firsts = F.slice(own, 1, F.greatest(F.lit(0), F.size(own) - (width - 1)))
    return F.transform(firsts, lambda x, i: joined(x, *(own[i + k] for k in range(1, width))))


def _hashed(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, t): the hash of each `width`-word shingle; words are hashed once.

    The outer explode keeps Catalyst from inferring a filter that would hash all words again for each shingle.
    """
    hashes = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    return hashes.select(*keys, _windows("h", width, lambda *x: F.xxhash64(*x)).alias("ts")).select(*keys, F.explode_outer("ts").alias("t"))


def _spelled(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, s): each `width`-word shingle as text, null for rows with fewer words."""
    return rows.select(*keys, _windows("words", width, lambda *x: F.concat_ws(" ", *x)).alias("ss")).select(*keys, F.explode_outer("ss").alias("s"))


def contained_items(documents: DataFrame, items: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id", item: str = "item_id", width: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each item found in a document."""
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    tests = items.select(F.col(item).alias("item_id"), word_list(F.col(text)).alias("words")).where(F.size("words") > 0)
    tests = stored(tests.withColumn("width", F.least(F.lit(width), F.size("words"))), "items")
    found = None
    for (w,) in sorted(tests.select("width").distinct().collect()):  # at most `width` sizes
        own = tests.where(F.col("width") == w)
        shingles = stored(_spelled(own, w, "item_id").where("s is not null").distinct(), "item-shingles")
        sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
        largest = F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles"))).cast("int")  # of the item's partition
        keep = largest - F.ceil(largest * F.lit(least) - F.lit(1e-9)).cast("int") + 1
        values = F.array_sort(F.collect_set("t"))
        sketch = _hashed(own, w, "item_id").groupBy("item_id").agg(values.alias("v")).join(sizes, "item_id")
        sketch = sketch.select("item_id", F.explode(F.slice("v", F.lit(1), keep)).alias("t"))
        sketch = stored(sketch, "sketch")
        worded = docs.select("doc_id", word_list(F.col("text")).alias("words"))
        near = _hashed(worded, w, "doc_id").join(small_side(sketch, sketch.count(), FEW), "t").select("doc_id", "item_id").distinct()
        near = stored(near, "candidates")
        ids = near.select("doc_id").distinct()
        short = docs.join(small_side(ids, near.count(), FEW), "doc_id", "left_semi").select("doc_id", word_list(F.col("text")).alias("words"))
        side = small_side(shingles, shingles.count(), FEW)
        met = _spelled(short, w, "doc_id").join(side, "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_found"))
        met = met.join(near, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
        share = F.col("n_found") / F.col("n_shingles")
        met = met.where(share >= F.lit(least)).select("doc_id", "item_id", "n_shingles", "n_found", share.alias("containment"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        kinds = f"doc_id {documents.schema[key].dataType.simpleString()}, item_id {items.schema[item].dataType.simpleString()}, n_shingles long, n_found long, containment double"
        return spark.createDataFrame([], kinds)
    return found
