"""Filter interaction audit: what each filter of a chain removes, in every order the chain can have.

Each document is judged once by all filters. Its verdicts, a bit mask, then meet every order of the filters (a broadcast
table of k! rows, 120 for five), each order is exploded into its steps, the document's first failing step in that order
is computed, and conditional sums by part, order and step say what the step kept and removed. The sums combine in the
tasks that replay the documents: what is shuffled is at most one row a part, order and step from each task.

Texts are read once. Copies are found by the SHA-256 of the text: of each digest that occurs twice the smallest
doc_id is kept, and documents ask for it by a join. Digests of more than 1 / `HOT_PARTS` of the rows (fewer than
`HOT_PARTS`) are broadcast, the others are joined by a shuffle, so no text gathers its copies in one task.

Defined cases: a null text is empty, a null part is the empty string. A document without doc_id has no smaller doc_id and
is none: it never fails for being a copy. Rows that repeat a doc_id count each; equal texts under one doc_id are not
copies of each other. A document with several labels is good (toxic) if one of them says so, one without labels is
neither. Empty tables give no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import WORD, hot_join, small_side, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = r"[#$%&*|]"
HOT_PARTS = 4096
FEW = 1_000_000
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> list[Column]:
    """The failure conditions of one text: few words, few distinct words, many capitals, a symbol."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.char_length(text),
        text.rlike(SYMBOLS),
    ]


def mask(verdicts: list[Column]) -> Column:
    """Verdicts as the bits of an int, the first the lowest."""
    total = F.lit(0)
    for k, fails in enumerate(verdicts):
        total = total + F.when(fails, 1 << k).otherwise(0)
    return total


def flagged(documents: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part and fails (bits in the order of FILTERS) of every document."""
    whole = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = stored(whole.select("doc_id", "part", mask(failures(F.col("_text"))).alias("_own"), F.unhex(F.sha2("_text", 256)).alias("_digest")), "flags")
    groups = stored(own.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1"), "copies")
    n = own.count()
    found = hot_join(own, groups, ["_digest"], F.col("_rows") > max(1, n // HOT_PARTS), "left")
    copy = F.when(F.col("doc_id") > F.col("_first"), 1 << (len(FILTERS) - 1)).otherwise(0)
    return found.select("doc_id", "part", (F.col("_own") + copy).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with good and toxic, by doc_id."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = stored(marks.where("good or toxic"), "marks").withColumn("_salt", F.lit(0).cast("long"))
    # rows without doc_id match nothing: dealt out, else a shuffle would put all of them into one task
    salted = rows.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0))
    met = salted.join(small_side(marks, marks.count(), FEW), (F.col("doc_id") == F.col("_doc")) & (salted["_salt"] == marks["_salt"]), "left")
    no = F.lit(False)
    return met.select("doc_id", "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(rows: DataFrame, filters: str) -> DataFrame:
    """Every order of the filters: its name, the step of each filter, and the filter of each step."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters: every order of them is replayed")
    made = [("".join(filters[k] for k in p), [p.index(k) + 1 for k in range(len(p))], list(p)) for p in permutations(range(len(filters)))]
    kind = T.StructType([T.StructField("filter_order", T.StringType(), False), T.StructField("_step_of", T.ArrayType(T.IntegerType(), False), False), T.StructField("_filter_at", T.ArrayType(T.IntegerType(), False), False)])
    return rows.sparkSession.createDataFrame(made, kind)


def replay(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts by part, filter_order and step over `rows` (part, fails, good, toxic), for any filters of one letter each."""
    k = len(filters)
    crossed = rows.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders(rows, filters)))  # k! rows
    own_steps = [F.when(F.getbit("fails", F.lit(i)) == 1, F.col("_step_of")[i]) for i in range(k)]
    first = F.coalesce(F.least(*own_steps) if k > 1 else own_steps[0], F.lit(k + 1))  # after the last: passes all
    met = crossed.withColumn("_first", first).select("part", "fails", "good", "toxic", "filter_order", "_first", F.posexplode("_filter_at").alias("_at", "_filter"))
    step = F.col("_at") + 1
    fails = F.getbit("fails", F.col("_filter")) == 1
    removed = F.col("_first") == step
    counts = {
        "kept": F.col("_first") > step,
        "removed": removed,
        "redundant": fails & (F.col("_first") < step),
        "unique_fails": fails & (F.bit_count("fails") == 1),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = met.groupBy("part", "filter_order", step.alias("step"), "_filter").agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    share = F.sum("removed").over(Window.partitionBy("part", "_filter"))  # one row an order
    return sums.select("part", "filter_order", "step", *COUNTS, share.alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """The replay of the five filters over whole texts."""
    return replay(with_labels(flagged(documents, text, key, part), labels))


def sql() -> str:
    """The same in DuckDB's SQL."""
    cross = ", ".join(f"(VALUES {', '.join(f'({k})' for k in range(5))}) t{k}(p{k})" for k in range(5))
    unlike = " AND ".join(f"p{i} <> p{j}" for i in range(5) for j in range(i))
    name = " || ".join(f"substr('{FILTERS}', p{k} + 1, 1)" for k in range(5))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, [a, b, c, d, e] AS v, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
o AS (SELECT {name} AS filter_order, [{', '.join(f'p{k}' for k in range(5))}] AS seq FROM {cross} WHERE {unlike}),
r AS (SELECT part, v, good, toxic, filter_order, seq, coalesce(list_min(list_filter(range(1, 6), lambda s: v[seq[s] + 1])), 6) AS first FROM v, o),
s AS (SELECT r.*, step FROM r, (VALUES (1), (2), (3), (4), (5)) x(step)),
t AS (SELECT part, filter_order, step::INTEGER AS step, seq[step] AS filter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
      count(*) FILTER (v[seq[step] + 1] AND first < step) AS redundant,
      count(*) FILTER (v[seq[step] + 1] AND len(list_filter(v, lambda x: x)) = 1) AS unique_fails,
      count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t"""
