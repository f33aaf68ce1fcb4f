import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import filter_audit, token_alignment
from strandloom.llm import html_extraction as H
from strandloom.llm.queries import op11_filter_audit, op13_html_extraction

from . import cases

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]


def replayed(docs, marks):
    """The audit of op11 row by row."""
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    rows = []
    for r in docs:
        t = r["text"] or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), r["doc_id"] is not None and r["doc_id"] > first[t])
        own = [m for m in marks if m[0] is not None and m[0] == r["doc_id"]]
        rows.append((r["lang"] or "", fails, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    out = {}
    for part in {r[0] for r in rows}:
        share = Counter()
        for order in itertools.permutations(range(5)):
            for step in range(1, 6):
                f, n = order[step - 1], Counter()
                for _, fails, good, toxic in (r for r in rows if r[0] == part):
                    at = next((k for k, x in enumerate(order, 1) if fails[x]), 6)
                    n["kept"] += at > step
                    n["removed"] += at == step
                    n["redundant"] += fails[f] and at < step
                    n["unique_fails"] += fails[f] and sum(fails) == 1
                    n["good_lost"] += at == step and good
                    n["toxic_lost"] += at == step and toxic
                share[f] += n["removed"]
                out[part, "".join("ABCDE"[k] for k in order), step] = [*(n[c] for c in filter_audit.COUNTS), f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = share[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_cases(spark, extra=False):
    docs = cases.frame(spark, extra)
    more = [(None, "a copy $"), (None, "a copy $"), (7, "a copy $"), (7, "a copy $"), (900, "a copy $"), (901, "UPPER " * 250), (902, " ".join(f"w{k}" for k in range(300)))]
    added = spark.createDataFrame([(k, t, None) for k, t in more], "doc_id long, text string, lang string")
    marks = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (900, 1, 1), (901, 0, 1), (77777, 1, 1)]
    return docs.unionByName(added, allowMissingColumns=True), marks


@pytest.mark.parametrize("few", [filter_audit.FEW, 0])
def test_audit_is_the_replay_row_by_row(spark, monkeypatch, few):
    monkeypatch.setattr(filter_audit, "FEW", few)
    docs, marks = audit_cases(spark, extra=True)
    got = filter_audit.audit(docs, spark.createDataFrame(marks, LABELS))
    assert got.columns == COLUMNS
    want = replayed([r.asDict() for r in docs.collect()], marks)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want and got.count() == len(want)


def test_audit_sql_says_the_same_of_awkward_rows(spark):
    docs, marks = audit_cases(spark)
    con = duckdb.connect()
    documents, labels = docs.toPandas(), spark.createDataFrame(marks, LABELS).toPandas()
    documents["doc_id"], labels = documents["doc_id"].astype("Int64"), labels.astype("Int64")
    con.register("documents", documents)
    con.register("labels", labels)
    want = {tuple(r[c] for c in COLUMNS[:3]): tuple(r[c] for c in COLUMNS[3:]) for r in con.sql(filter_audit.sql()).df().to_dict("records")}
    got = filter_audit.audit(docs, spark.createDataFrame(marks, LABELS))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want


def test_audit_laws_and_edges(spark):
    assert filter_audit.audit(cases.empty(spark), spark.createDataFrame([], LABELS)).collect() == []
    got = op11_filter_audit(spark, SMALL)
    sums = got.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("left"), F.count("*").alias("n")).collect()
    sizes = {r["lang"] or "": r["count"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").groupBy("lang").count().collect()}
    assert all(r.n == 5 and r.gone + r.left == sizes[r.part] for r in sums) and len(sums) == 120 * len(sizes)
    with pytest.raises(ValueError):
        filter_audit.orders(got, "ABCDEFG")
    two = spark.createDataFrame([("x", 3, True, False), ("x", 2, False, False)], "part string, fails int, good boolean, toxic boolean")
    assert {(r.filter_order, r.step): (r.removed, r.redundant) for r in filter_audit.replay(two, "AB").collect()} == {("AB", 1): (1, 0), ("AB", 2): (1, 1), ("BA", 1): (2, 0), ("BA", 2): (0, 1)}


def aligned(texts):
    """The alignment of op12, each text tokenised whole, all pairs of tokens tried."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.VOCABULARY_B)
    letters = token_alignment._byte_letters()
    found = []
    for t in texts:
        ours, theirs = a.encode(" " + (t or ""), add_special_tokens=False), b.encode(t or "")
        left = [bytes(letters[c] for c in x) for x in ours.tokens]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(theirs, map(b.id_to_piece, theirs), strict=True)]
        if not t or b"".join(left) != (" " + t).encode() or b"".join(right) != (" " + t).encode():
            found.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (left, right)]
        links = [(ours.ids[i], theirs[j]) for i in range(len(left)) for j in range(len(right)) if ends[0][i] - len(left[i]) < ends[1][j] and ends[1][j] - len(right[j]) < ends[0][i]]
        cuts = [0, *sorted({*ends[0]} & {*ends[1]})]
        name = ";".join("|".join(",".join(str(k) for k, e in zip(ids, end, strict=True) if lo < e <= hi) for ids, end in ((ours.ids, ends[0]), (theirs, ends[1]))) for lo, hi in itertools.pairwise(cuts))
        found.append((len(left), len(right), len(cuts) - 1, links, hashlib.sha256(name.encode()).hexdigest()))
    n = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, y), c in n.items():
        best[y] = max(best.get(y, 0), c)
    return [(*f[:3], len(f[3]), sum(n[x] == best[x[1]] for x in f[3]), sum(n[x] for x in f[3]), f[4]) if f else (0,) * 6 + ("",) for f in found]


ODD = [None, "", " ", "  ", "a", "a ", "a  b", " a\n b\n  c", "x▁y", "naïve\x1c ca fé 漢字かな交じり <|endoftext|> <s> </s>", "it's we'll  'd", "\t\n", "don't  x", "a\x85 b", "😀😀 é", "aGVsbG8gd29ybGQhIQ==", "the the the", "the the the", "é ü 漢字 \x00 z", "a　b 　 c", "x " * 300, "\r\n\r\n  y", "z" * 500, "<0x41> <unk>"]


@pytest.mark.parametrize("hot", [1 << 17, 1 << 30, 2])
def test_alignment_is_that_of_both_libraries(spark, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_GROUPS", hot)
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    rng = random.Random(5)
    letters = "ab \n\té漢-'0😀▁"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 1, "s", 5) for k, t in enumerate(texts)], "doc_id long, text string, _row int, `group` string, n_a int")
    made = token_alignment.align(docs)
    assert made.documents.columns == ["doc_id", "_row", "group", *token_alignment.MADE]
    got = {r[0]: tuple(r)[3:] for r in made.documents.collect()}
    want = dict(enumerate(aligned(texts)))
    assert got == want
    assert sum(v[3] for v in want.values()) == made.pairs.agg(F.sum("count")).first()[0]


def test_groups_of_one_hash_are_told_apart(monkeypatch):
    tokens = token_alignment.Tokens.load(*(open(p, "rb").read() for p in (token_alignment.VOCABULARY_A, token_alignment.VOCABULARY_B)))
    (a, b), *_ = tokens.encode(["the same words and the other words, the same 1234567 times"])
    want = token_alignment.grouped(np.array(a), np.array(b), tokens)
    mixed, calls = token_alignment.mixed, []

    def weak(x):
        calls.append(1)
        return mixed(x) if len(calls) > 4 else np.zeros_like(x)

    monkeypatch.setattr(token_alignment, "mixed", weak)
    got = token_alignment.grouped(np.array(a), np.array(b), tokens)
    assert [got.names[k] for k in got.like] == [want.names[k] for k in want.like] and len(calls) > 4


def test_alignment_edge_cases(spark):
    assert token_alignment.align(cases.empty(spark)).documents.collect() == []
    rows = token_alignment.align(cases.frame(spark, extra=True)).documents
    assert rows.count() == len(cases.rows())
    alone = token_alignment.align(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")).documents.collect()
    assert sorted(r.n_a for r in alone) == [0, 2, 2]


def least_cut(costs, joined):
    """All labellings tried: the least cost, and of those the fewest sources."""
    best = None
    for sides in itertools.product((False, True), repeat=len(costs)):
        loss = sum(max(0, c) if not s else max(0, -c) for c, s in zip(costs, sides, strict=True)) + sum(c for a, b, c in joined if sides[a] != sides[b])
        key = (loss, sum(sides))
        if best is None or key < best[0]:
            best = (key, list(sides))
    return best


def test_cut_is_least_of_all_labellings():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randrange(1, 9)
        costs = [rng.randrange(-6, 7) for _ in range(n)]
        joined = [(a, b, rng.randrange(0, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        assert H.cut(costs, joined) == least_cut(costs, joined)[1]


def test_cut_of_a_large_page_and_of_none():
    rng = random.Random(2)
    n = 30_000
    costs = [rng.randrange(-1500, 1500) for _ in range(n)]
    joined = [(k, k + 1, 1024) for k in range(n - 1)] + [(k, k + 7, 512) for k in range(n - 7)]
    sides = H.cut(costs, joined)
    assert 0 < sum(sides) < n and H.cut([], []) == []


LONG = "This paragraph tells a story at some length, with commas, with clauses, and it ends as sentences do."
PAGES = {
    "plain": ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &amp; two.<p>Short.<br></article><footer>&copy; us</footer>", "Title\n\nOne & two.\n\nShort."),
    "inside": (f"<article><h1>T</h1><p>{LONG}</p><aside><p>{LONG}</p></aside><div class='share-buttons'>Share this</div><p>Yes.</p><section id=comments><h2>Comments</h2><article class=comment><p>{LONG}</p></article></section></article>", f"T\n\n{LONG}\n\nYes."),
    "unmarked": (f"<div><a href=1>One</a> | <a href=2>Two</a></div><div><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>© 2020 us</div>", f"{LONG}\n\n{LONG}\n\nShort.\n\n{LONG}"),
    "words": (f"<div class='cookie-notice'><p>{LONG}</p></div><div class='post-content'><p>{LONG}</p><ul><li>first item</li><li>second item</li></ul></div><div id='sidebar-right'><p>{LONG}</p></div>", f"{LONG}\n\nfirst item\n\nsecond item"),
    "odd": (f"<article><script>if (a < b) {{ x = '<p>no</p>' }}</script><style>p {{}}</style><!-- <p>no</p> --><p title='a > b'>{LONG}</p><p>a < b &lt;i&gt; caf&eacute;&nbsp;x &#233;</p><p hidden>no</p><form><label>Mail</label><button>Send</button></form><p>cut <b>off", f"{LONG}\n\na < b <i> café x é\n\ncut off"),
    "form": (f"<form><div>Search <input></div><main><p>{LONG}</p></main></form>", LONG),
    "header": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    "none": ("", ""),
    "null": (None, ""),
    "menu": ("<nav><ul><li><a href=a>a</a><li><a href=b>b</a></ul></nav>", ""),
}


@pytest.mark.parametrize("counts", [[], None])
def test_main_texts_of_planted_pages(spark, counts):
    logits = H.fit([]) if counts == [] else H.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))
    pages = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in PAGES.items()], "page_id string, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(pages, logits).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in PAGES.items()}


def test_learned_costs_tell_articles_from_menus(spark):
    logits = H.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))
    article, menu = H.Block(LONG, 0, 0, 0.0, (1,)), H.Block("Home", 2, 0, 1.0, (1,))
    assert logits[H.bucket(article)] > 0 > logits[H.bucket(menu)]
    assert len(logits) == H.BUCKETS and np.isfinite(logits).all() and H.bucket(H.Block("w " * 99 + "|.", 4, 0, 1.0, ())) < H.BUCKETS


def test_pages_give_one_row_each_and_their_articles(spark):
    import html

    got = {r.page_id: r.text for r in op13_html_extraction(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:  # the test pages keep their article in one element
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        texts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner))
        assert got[r.page_id] == "\n\n".join(t for t in texts if t)


def test_blocks_as_rows_and_empty_tables(spark):
    schema = "page_id long, url string, html string"
    logits = H.fit([])
    assert H.extract(spark.createDataFrame([], schema), logits).collect() == [] and H.learn(spark.createDataFrame([], schema)).tolist() == logits.tolist()
    rows = H.labelled(spark.createDataFrame([(1, "u", PAGES["plain"][0]), (2, "u", None), (2, "u", ""), (None, "u", "<p>x y z w</p>")], schema), logits)
    assert [(r.page_id, r.place, r.content) for r in rows.orderBy("page_id", "place").collect()] == [(None, 0, True), (1, 0, False), (1, 1, True), (1, 2, True), (1, 3, True), (1, 4, False)]
    big = "<article>" + "<p>word</p>" * 50_000 + "<div " + "x" * 10
    assert H.extract(spark.createDataFrame([(1, "u", big)], schema), logits).first().n_chars == 50_000 * 6 - 2


def test_many_open_tags_stay_fast():
    assert [b.text for b in H.blocks("<div>" * 3000 + "x" + "</section></div>" * 3000 + "<p>y")] == ["x", "y"]
    assert H.blocks("<" * 20_000 + " " + "a" * 10)[0].text.endswith("a" * 10)
    assert len(H.blocks("<a href=\"" * 3000)) <= 1
