"""The corpus queries: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, filter_audit, html_extraction, language_id, license_scan, mixing, ngram_jaccard, quality, secret_scan, sharding, substring_dedup, token_alignment, vector_search
from strandloom.llm.common import held_out, small_side, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    profiles = language_id.trained_on(documents, out)
    return language_id.identify(documents.select("doc_id", out.alias("held_out"), "text"), profiles).drop("text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(rows, F.col("vec_id") % 50 == 0, 5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = quality.sampled(table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))), "doc_id").select("doc_id", F.col("quality").alias("label"))
    n = marked.count()
    labelled = documents.join(small_side(marked, n, 2 * quality.SAMPLE), "doc_id").withColumnRenamed("doc_id", "key")
    scored = quality.score(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), quality.train(labelled, shards=quality.shards_for(n)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text")).documents


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages, html_extraction.learn(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_decontamination, op4_vector_search, op5_license_scan, op6_quality, op7_sharding, op8_mixing, op9_secret_scan, op10_substring_dedup, op11_filter_audit, op12_token_alignment, op13_html_extraction)}


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(text), {quote(license_scan.COPYRIGHT_LINE)}, ' \\1', 'g')"
    form = f"concat(' ', regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ')"
    for old, new in license_scan.SPELLINGS:
        form = f"replace({form}, ' {license_scan.spaced(old)} ', ' {license_scan.spaced(new)} ')"
    form = f"trim(regexp_replace({form}, ' +', ' ', 'g'))"
    texts = ", ".join(f"({quote(name)}, {quote(body)})" for name, body in sorted(license_scan.KNOWN.items()))
    digest = f"CASE WHEN text IS NOT NULL AND length({form}) > 0 THEN sha256({form}) END"
    return f"""
WITH known AS (SELECT {digest} AS k, min(name) AS license FROM (VALUES {texts}) t(name, text) GROUP BY 1),
d AS (SELECT doc_id, {digest} AS digest FROM documents)
SELECT d.doc_id, d.digest, known.license FROM d LEFT JOIN known ON d.digest = known.k"""


def oracle_sql() -> dict[str, str]:
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda v: v <> '')"
    shingles = "list_transform(range(1, greatest(0, len(w) - least(5, {n}) + 1) + 1), lambda i: array_to_string(w[i : i + least(5, {n}) - 1], ' '))"
    return {
        "op3_decontamination": f"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT item_id, w, least(5, len(w)) AS width FROM items WHERE len(w) > 0),
shingle AS (SELECT DISTINCT item_id, width, unnest({shingles.format(n='len(w)')}) AS s FROM sizes),
n AS (SELECT item_id, count(*) AS n_shingles FROM shingle GROUP BY item_id),
worded AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, greatest(0, len(w) - width + 1) + 1), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS s
       FROM worded, (SELECT DISTINCT width FROM sizes) x),
met AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN shingle USING (width, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM met JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles""",
        "op4_vector_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op5_license_scan": _license_sql(),
        "op11_filter_audit": filter_audit.sql(),
    }
