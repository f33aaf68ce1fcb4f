import itertools
import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import mixing, sharding
from strandloom.llm import vector_search as V

from . import cases


def brute_top(rows, is_query, k):
    vectors = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = {}
    for q, own in vectors.items():
        if is_query(q):
            for v in own:
                found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, ws in vectors.items() if i != q for w in ws if len(w) == len(v)]
                out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return {q: x for q, x in out.items() if x}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [None] * 8), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7), (510, [0.1, 0.2]), (511, [0.3, 0.1]), (520, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in V.top_k(df, F.col("vec_id") % 10 == 0, 5, block=64, query_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute_top(rows, lambda q: q % 10 == 0, 5)
    assert V.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).collect() == []


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_bounds_hold_whatever_the_components():
    rng = np.random.default_rng(5)
    for most in (9, 10**7, 1 << 28):
        exact = rng.integers(-most, most, (300, 4))
        exact[50:90] = exact[7]
        ids = np.sort(rng.permutation(1000)[:300])
        cells, low, width = V.approximations(exact)
        assert ((low + cells * width <= exact) & (exact <= low + cells * width + width - 1)).all()
        for qid, lows, found, upper in V.bounds(ids[:40], exact[:40], ids, low, width, cells, 5):
            q = exact[ids.tolist().index(qid)].tolist()
            score = {i: sum(a * b for a, b in zip(q, v, strict=True)) for i, v in zip(ids.tolist(), exact.tolist(), strict=True) if i != qid}
            best = sorted(score.values(), reverse=True)[:5]
            assert {i for i, x in score.items() if x >= best[-1]} <= set(found.tolist())
            assert all(score[i] <= u for i, u in zip(found.tolist(), upper.tolist(), strict=True)) and min(lows) <= best[-1]


def test_top_k_of_large_components_equal_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.choice([-4e4, -1.0, 0.0, 3.5, 3e4], 3)]) for i in range(60)]
    rows += [(i, [1e4, 2e4, -3e4]) for i in range(100, 190)]  # one vector very often
    rows += [(0, rows[0][1]), (10, rows[10][1]), (7, rows[7][1])]  # rows given twice
    rows += [(20, [-5e4, 0.0, 0.0]), (33, [-6e4, 9.0, 9.0])]  # another vector for an id: the smaller one counts
    kept = {}
    for i, v in rows:
        kept[i] = min(v, kept.get(i, v))
    df = spark.createDataFrame(rows + [(None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    for read in (1, 32):
        assert collected(V.top_k(df, F.col("vec_id") % 10 == 0, 5, block=40, query_block=8, read=read)) == brute_top(sorted(kept.items()), lambda q: q % 10 == 0, 5)


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = cases.rows()
    found = sharding.shard_by_bytes(cases.frame(spark, extra=True), 4).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] for r in rows}
    total = sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    for s in range(4):
        own = [r for r in found if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(4)]
    assert sum(sizes) == total and max(r.size for r in found) >= max(sizes) - min(sizes) - total / 40
    for r in found:
        t = text[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()), "bytes", None)
    assert sharding.shard_by_bytes(cases.empty(spark), 4).collect() == []


def test_a_hot_text_is_split_but_small_groups_are_not(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_PARTS", 4)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot " * 50).otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2), F.lit("x" * 190))).alias("text"))
    found = sharding.shard_by_bytes(docs, 10)
    sizes = [r.s for r in found.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.02 * sum(sizes)
    parts = found.join(docs, "doc_id").where("doc_id >= 3000").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 200), st.integers(1, 64))
def test_fit_takes_what_exists_and_comes_close(counts, budget, exact):
    taken = mixing.fit(counts, budget, exact)
    size = sum(x * n for x, n in counts.items())
    assert all(0 <= n <= counts[x] for x, n in taken.items())
    total = sum(x * n for x, n in taken.items())
    assert total <= max(0, budget) and (budget < size or total == size)


def test_fit_equals_brute_force_on_the_last_words():
    counts = {3: 2, 5: 2, 11: 1, 17: 1}
    pool = [x for x, n in counts.items() for _ in range(n)]
    for budget in range(45):
        best = max(s for k in range(len(pool) + 1) for s in map(sum, itertools.combinations(pool, k)) if s <= budget)
        base = {x: n * budget // sum(pool) for x, n in counts.items()}
        got = sum(x * n for x, n in mixing.fit(counts, budget, 1000).items())
        # exact among the choices that keep each length's proportional share
        rest = [x for x, n in counts.items() for _ in range(n - base[x])]
        floor = sum(x * n for x, n in base.items())
        assert got == (sum(pool) if budget >= sum(pool) else max(floor + s for k in range(len(rest) + 1) for s in map(sum, itertools.combinations(rest, k)) if floor + s <= budget)) and got <= best


def test_targets_share_the_excess():
    got = mixing.targets({"b": 10, "a": 100, None: 50, "c": 40})
    assert math.isclose(sum(got.values()), 200)
    # a 5, b 2 (stops at 30), c 1, null 5: by code point, null last, weights repeat after three
    assert got["b"] == 30 and math.isclose(got["a"], got["c"] * 5) and math.isclose(got[None], got["a"])
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mix_reaches_its_targets(spark):
    rows = cases.rows()
    first, again = (mixing.mix(cases.frame(spark, extra=True)).collect() for _ in range(2))
    assert len(first) == len(rows) and sorted(map(repr, first)) == sorted(map(repr, again))
    size = {r[0]: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r[1] or "")]) for r in rows}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in first)
    for s in {r.source for r in first}:
        own = [r for r in first if r.source == s]
        assert len({(r.source_size, r.target) for r in own}) == 1
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert math.isclose(sum({r.source: r.target for r in first}.values()), sum(r["size"] for r in first))
    assert mixing.mix(cases.empty(spark)).collect() == []


def test_light_texts_of_many_copies_stay_in_one_shard(spark):
    n = 1100  # copies: more than the least count of a hot text; 61 texts of 1 / 30 of a shard each, one over the cut
    docs = spark.range(61 * n).select(F.col("id").alias("doc_id"), F.format_string("x%02d", F.floor(F.col("id") / n)).alias("text"))
    got = sharding.shard_by_bytes(docs, 2).cache()
    assert got.count() == 61 * n and got.select("shard").distinct().count() == 2
    assert got.groupBy(F.floor(F.col("doc_id") / n)).agg(F.count_distinct("shard").alias("s")).where("s > 1").count() == 0
    assert got.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("whole")).where("not whole").count() == 0


def test_shards_of_awkward_rows_are_whole_gapless_and_even(spark):
    rows = [(i, t) for i, t, *_ in cases.rows() if i is not None] + [(1000 + k, f"text {k} " * (k % 9)) for k in range(200)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = lambda t: 16 + len((t or "").encode())
    assert sorted((r.doc_id, str(r.text_crc32), r.size) for r in found) == sorted((i, str(None if t is None else zlib.crc32(t.encode())), size(t)) for i, t in rows)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for k in range(8):
        own = [r for r in found if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 2 * largest + total / 8 / 20


def test_pairs_of_blocks_are_never_broadcast(spark, monkeypatch):
    plans, real = {}, V.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(V, "stored", seen)
    df = spark.createDataFrame([(i, [i / 50, 1 - i / 50]) for i in range(60)], "vec_id long, embedding array<double>")
    assert V.top_k(df, F.col("vec_id") % 10 == 0, 5, block=16, query_block=4).count() == 30
    assert "BroadcastHashJoin" not in plans["bounds"]
