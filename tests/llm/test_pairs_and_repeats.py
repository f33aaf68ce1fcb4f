import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ngram_jaccard as J
from strandloom.llm import substring_dedup as S
from strandloom.llm.components import connected

from . import cases


def jaccard_components(rows, size, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,num,den,chunk", [(3, 90, 100, 256), (5, 80, 100, 256), (3, 60, 100, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, size, num, den, chunk):
    monkeypatch.setattr(J.components_of_blocks, "__defaults__", (chunk, J.CHUNK_TOKENS))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar(cases.frame(spark, extra=True), size, num, den).collect()}
    assert got == jaccard_components(cases.rows(), size, num, den)


def test_jaccard_of_an_empty_table_and_of_repeated_rows(spark):
    assert J.similar(cases.empty(spark)).collect() == []
    assert J.similar(cases.frame(spark)).count() == len(cases.rows())


def test_jaccard_links_near_copies_of_rows_that_stand_several_times(spark):
    rows = []
    for k in range(12):  # 46 words are 44 shingles; without the last four words 40 of them: 40 / 44 links at 0.9
        words = [f"u{k}x{j}" for j in range(46)]
        rows += [(2 * k, " ".join(words))] * 5 + [(2 * k + 1, " ".join(words[:42]))]
    got = J.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = jaccard_components(rows, 3, 90, 100)
    assert sorted(tuple(r) for r in got) == sorted((i, *want[i]) for i, _ in rows)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(12))


def test_jaccard_of_null_and_clashing_doc_ids(spark):
    one, two, three = (" ".join(f"{c}{j}" for j in range(50)) for c in "abc")
    rows = [(7, one), (7, two), (8, one), (9, two + " more"), (None, two), (None, three), (None, None), (5, three + " end")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(7, 48, 7), (7, 48, 7), (8, 48, 7), (9, 49, 7), (0, 48, 7), (0, 48, 5), (0, 0, 0), (5, 49, 5)])


def test_search_finds_all_links_of_random_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 200)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.0, 0.03, 0.08]), rng.integers(0, 1 << 40, 200), base)) for _ in range(40)]
    limit = J.Threshold(90, 100)
    want = {frozenset((i, j)) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    for a in range(40):  # one query against all: nothing is connected before, every component is met once
        others = [s for k, s in enumerate(sets) if k != a]
        names = [k for k in range(40) if k != a]
        lists = J.Lists(others, [None] * 39, limit)
        got = {frozenset((a, names[c])) for _, c in lists.ask(sets[a], lists.forest.add(None))}
        assert got == {x for x in want if a in x}


def prose(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


BARE = {
    "one row": [(3, prose("a", 80))],
    "two unrelated": [(3, prose("a", 80)), (4, prose("b", 90))],
    "two equal": [(3, prose("a", 80)), (4, prose("a", 80))],
    "all distinct": [(k, prose(f"d{k}x", 60 + k)) for k in range(9)],
    "only empty": [(1, ""), (2, None), (3, "  ")],
}


@pytest.mark.parametrize("tokens", [J.BUCKET_TOKENS, 16])
@pytest.mark.parametrize("name", sorted(BARE))
def test_jaccard_where_little_or_nothing_is_shared(spark, monkeypatch, name, tokens):
    monkeypatch.setattr(J, "BUCKET_TOKENS", tokens)
    got = sorted(tuple(r) for r in J.similar(spark.createDataFrame(BARE[name], "doc_id long, text string")).collect())
    assert got == sorted((i, *x) for i, x in jaccard_components(BARE[name], 3, 90, 100).items())


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def removed(rows, width):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first.setdefault(b[k : k + width], i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("width,bytes_", [(50, 16 << 20), (20, 2000)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, width, bytes_):
    monkeypatch.setattr(S, "BUCKET_BYTES", bytes_)
    monkeypatch.setattr(S, "SHARD_BYTES", bytes_)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in S.deduplicate(cases.frame(spark, extra=True), width).collect()}
    assert got == removed(cases.rows(), width)


def test_substring_dedup_of_an_empty_table(spark):
    assert S.deduplicate(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(BARE))
def test_substring_dedup_where_little_or_nothing_is_shared(spark, monkeypatch, name):
    for bytes_ in (16 << 20, 64):
        monkeypatch.setattr(S, "BUCKET_BYTES", bytes_)
        monkeypatch.setattr(S, "SHARD_BYTES", bytes_)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in S.deduplicate(spark.createDataFrame(BARE[name], "doc_id long, text string")).collect()}
        assert got == removed(BARE[name], 50)


@pytest.mark.parametrize("width", [20, 400])
def test_substring_dedup_of_wide_and_narrow_strings_and_few_anchors_a_flush(spark, monkeypatch, width):
    monkeypatch.setattr(S, "FLUSH_ANCHORS", 40)
    monkeypatch.setattr(S, "SHARD_BYTES", 3000)
    rows = [(k, prose("p", 70 + k) + " " + prose(f"d{k % 4}x", 200) + " " + prose("q", 90)) for k in range(12)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    assert got == removed(rows, width)


def test_substring_dedup_of_null_and_clashing_doc_ids(spark):
    a, b, c = prose("a", 30), prose("b", 30), prose("c", 30)
    rows = [(0, a), (1, a), (1, b), (2, b), (3, a + b), (4, c), (4, c), (None, c), (None, prose("z", 40)), (None, None), (None, prose("z", 40))]
    got = sorted((9 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(a)
    assert got == sorted([(0, n, 0, a), (1, n, n, ""), (1, n, 0, b), (2, n, n, ""), (3, 2 * n, 2 * n, ""), (4, n, 0, c), (4, n, 0, c), (9, n, n, ""), (9, len(prose("z", 40)), 0, prose("z", 40)), (9, 0, 0, ""), (9, len(prose("z", 40)), 0, prose("z", 40))])


def test_contents_of_one_fingerprint_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = np.frombuffer(b"aaabbbaaabbbaac", np.uint8)
    begins = np.arange(0, 15, 3)
    order, new, least = S._named(text, begins, begins + 3, np.zeros(5, np.int64), np.array([5, 4, 3, 2, 1]))
    groups = np.cumsum(new) - 1
    assert {frozenset(order[groups == g].tolist()): int(least[g]) for g in range(3)} == {frozenset({0, 2}): 3, frozenset({1, 3}): 2, frozenset({4}): 1}


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_arrays_and_common_prefixes_are_whole(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 7, 8, 9, 60, 400):
        for low in (0, 97):
            text = rng.integers(low, low + letters, n).astype(np.uint8)
            raw = text.tobytes()
            order = S.suffix_array(text)
            assert order.tolist() == sorted(range(n), key=lambda k: raw[k:])
            common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            want = [0] * bool(n) + [common(raw[i:], raw[j:]) for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]
            assert S.common_prefixes(text, order).tolist() == want


def test_groups_of_equal_strings():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[500:700] = text[1500:1700]
    starts = np.arange(0, 2900)
    order, fresh = S.suffix_groups(text, starts, 50)
    strings = [text[k : k + 50].tobytes() for k in order]
    assert strings == sorted(strings)
    assert fresh.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:], strict=False)]


def test_arrays_are_merged_by_binary_search():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 123, 300).astype(np.uint8)
    docs, starts, counts, parts = [], [], [], []
    for k in range(30):
        a = int(rng.integers(0, 40))
        part = base[a : a + 49 + int(rng.integers(1, 20))]
        docs.append(k // 2)
        starts.append(1000 * (k % 2))
        counts.append(len(part) - 49)
        parts.append(part)
    ends = np.cumsum([len(p) for p in parts])
    args = (np.array(docs), np.array(starts), np.array(counts), np.zeros(30, np.int64), np.concatenate(parts), ends - [len(p) for p in parts], ends)

    def covered(array_bytes):
        return {(d, x) for d, s, e in zip(*(x.tolist() for x in S.resolve(*args, 50, array_bytes)), strict=True) for x in range(s, e)}

    first = {}
    for d, p in zip(docs, parts, strict=True):
        for k in range(len(p) - 49):
            first.setdefault(p[k : k + 50].tobytes(), d)
    want = {(d, s + x) for d, s, p in zip(docs, starts, parts, strict=True) for k in range(len(p) - 49) if first[p[k : k + 50].tobytes()] < d for x in range(k, k + 50)}
    assert covered(200) == covered(1 << 20) == want


def test_long_rows_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    found = []
    for row, start, piece, at in S._pieces(data, np.array([0, 5000]), 50):
        first, count, _ = S.stretches(piece, at, 50)
        found += [start + x for a, n in zip(first.tolist(), count.tolist(), strict=True) for x in range(a, a + n)]
    assert found == list(range(5000 - 49))


def test_sets_digest_counts(spark):
    counts = Counter(r.n for r in J.set_rows(cases.frame(spark), 3, J.Threshold(90, 100)).select(F.col("n")).collect())
    assert sum(counts.values()) == len(cases.rows())
