import corpus_pipeline as P
from pyspark.sql import functions as F
from strandloom.llm import mixing

from . import cases
from .test_pairs_and_repeats import jaccard_components
from .test_texts import contained

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = P.language(spark, docs, SMALL).cache()
    assert kept.columns == docs.columns and kept.count() == docs.count()
    rows = texts(kept)
    near = P.near_duplicates(spark, kept, SMALL).cache()
    groups = jaccard_components(rows, 5, 80, 100)
    assert sorted(r[0] for r in texts(near)) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = P.decontaminate(spark, near, SMALL).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in contained(texts(near), items)}
    assert leaked and sorted(r[0] for r in texts(clean)) == sorted(i for i, _ in texts(near) if i not in leaked)
    mixed = P.mix(spark, clean, SMALL).cache()
    want = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in mixing.mix(clean).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got == {k: v for k, v in want.items() if v}
    out = P.shard(spark, mixed, SMALL)
    assert out.count() == mixed.count() and out.agg(F.max("shard")).first()[0] < P.SHARDS


def test_stages_stand_awkward_and_empty_tables(spark):
    docs = cases.frame(spark, extra=True)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name != "sharding":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).collect() == []
        docs = out
    assert docs.count() > 0


def test_language_rejects_what_is_no_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 !!"), (10**6 + 1, None), (10**6 + 2, "qqq xxz zqk kkkk jjj vvv qx zzz")], "doc_id long, text string")
    got = P.language(spark, docs.unionByName(junk, allowMissingColumns=True), SMALL)
    assert got.where(F.col("doc_id") >= 10**6).count() == 0 and got.count() == docs.count()


def test_rows_of_null_and_clashing_doc_ids_are_judged_one_by_one(spark):
    text = lambda k, n=40: " ".join(f"{'abcdefgh'[k]}{j}" for j in range(n))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text is not null").first().text
    plain = [(1, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (4, text(4)), (4, text(4)), (5, ""), (5, ""), (5, None), (None, ""), (None, ""), (6, text(0) + " end")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in plain], "doc_id long, text string, source string")
    key = lambda rows: sorted(rows, key=repr)
    near = P.near_duplicates(spark, docs, SMALL)
    kept = [(1, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (4, text(4)), (5, ""), (5, None), (None, ""), (None, "")]
    assert key(texts(near)) == key(kept)
    leaks = spark.createDataFrame([(1, item, "s"), (None, item, "s")], docs.schema)
    assert key(texts(P.decontaminate(spark, near.unionByName(leaks), SMALL))) == key(kept)
    # one source: all its words are the target, so every row with words is taken once
    mixed = P.mix(spark, docs, SMALL)
    assert mixed.columns == docs.columns and key(texts(mixed)) == key([r for r in plain if r[1]])
    two = docs.unionByName(spark.createDataFrame([(None, text(5), "t")] * 3 + [(1, text(6), None)], docs.schema))
    want = sum(r.taken for r in mixing.mix(two).collect())
    assert sum(len(t.split()) for _, t in texts(P.mix(spark, two, SMALL))) == want
