"""N-gram Jaccard self-join: T-occurrence search with DivideSkip, and the components its links form.

A document's set is its distinct word shingles as 63-bit hashes. Documents of equal sets form one class, named by
its smallest doc_id; only classes are compared.

1. Two sets of n shingles or more that link share at least T = ceil(threshold * n). A set with more than n - T
   shingles that occur in no other class can link with nothing. Occurrences are counted over all documents, in the
   lowest range of the hashes (a bound from part of a set holds for all of it), packed into byte strings.
2. Of the sets left, the n - T + 1 rarest shingles (within hash ranges, a global order) must meet those of a partner,
   and a partner's size lies within the threshold of the set's own. Sets that share such a shingle and a class of sizes
   are tied, and the components of these ties are blocks: links never leave a block.
3. Each block is searched by DivideSkip: for each query set the lists of its shingles are parted by length, the short
   ones are merged (each is sorted, so a merge sort of their runs in numpy takes the heap's place) and sets that stand in
   enough of them to reach T still are probed for in the long ones by binary search. Pairs already connected are not probed. Blocks are cut into chunks of bounded size: first each
   chunk is searched within, then one set of each component found is searched for in the block's other chunks, and at
   last every set outside the block's largest component; each only in chunks that hold one of its rarest shingles. A pair
   across chunks that is never probed lies in one component already, so no component is split.

Defined cases: null text and text without words have an empty set and link with nothing (a component of one). With
fewer words than a shingle the whole sequence is the one shingle. Rows that repeat a doc_id and text are equal and get
equal rows. Where a doc_id is null or repeated every row is searched by a number of its own, so a prefix holds distinct
shingles and rows of one doc_id and several texts are compared each by its text; a component is named by its smallest
doc_id, or null where none of its rows has one. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import identified, mixed, shingle_sets, slices, small_side, stored, tidied, utf8
from strandloom.llm.components import connected

FULL = 1 << 63
SMALL_SET = 64
BUCKET_TOKENS = 1 << 20
FLUSH_TOKENS = 4 << 20
FLUSH_SETS = 60_000
PART_CLASSES = 1 << 16
CHUNK_SETS, CHUNK_TOKENS = 2048, 2 << 20
TASK_SETS = 512
FEW = 1_000_000
NEAR_WORDS, NEAR = 5, (80, 100)
SKIP = 0.0085  # weight of a merge step against a probe in the choice of how many lists to skip


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # 1.875 times the prefix: enough to reject sets of mostly unique shingles
        self.low = int(FULL * min(1.0, 1.875 * (den - num) / den))
        self.mid = max(self.low, FULL // 2)

    def least(self, n: int) -> int:
        """The fewest shared shingles with which a set of n can link."""
        return -(-self.num * n // self.den)

    def size_class(self, n: Column) -> Column:
        """Sets that can link lie in one class or in two that follow each other."""
        return F.floor(F.log(n) / F.lit(math.log(self.den / self.num) * (1 + 1e-9))).cast("int")

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def sketch(self, tokens: np.ndarray) -> np.ndarray:
        """Whole hash ranges of the set, lowest first, that hold its prefix for certain."""
        n = len(tokens)
        need = n - self.least(n) + 1
        if n < SMALL_SET:
            return tokens
        for edge in (self.low, self.mid):
            if edge < FULL and (k := int(np.searchsorted(tokens, edge))) >= need:
                return tokens[:k]
        return tokens


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch's last column."""
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    for i, j in slices(offsets):
        yield from enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size), i)


def _digest(tokens: np.ndarray, seed: int) -> int:
    return int(mixed(tokens.astype(np.uint64) + np.uint64(seed)).sum().astype(np.int64))


def set_rows(documents: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """(doc_id, n, low, a, b): the set's size, how many of its hashes are low, and two digests of it."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low, a, b = ([0] * batch.num_rows for _ in range(4))
            for k, tokens in _sets(batch, size):
                n[k], low[k] = len(tokens), int(np.searchsorted(tokens, np.int64(min(limit.low, FULL - 1))))
                a[k], b[k] = _digest(tokens, 0x9E37), _digest(tokens, 0x79B97F4A7C15)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, low, a, b))], names=["doc_id", "n", "low", "a", "b"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, low long, a long, b long")


def shared_counts(documents: DataFrame, size: int, limit: Threshold, buckets: int, parts: int = 1) -> DataFrame:
    """(a, shared): how many of a class's low hashes occur in another class too; classes with none are left out.

    Each bucket of hashes sends its counts on packed, one row for each of `parts` of the classes, where they are added.
    """

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        digests: dict[int, None] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            every = np.fromiter(digests, np.int64, len(digests))
            bucket = tokens % buckets
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order] // buckets, owner[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                i, j = cuts[k], cuts[k + 1]
                if i < j:
                    used, at = np.unique(owner[i:j], return_inverse=True)
                    short = tokens[i:j].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]
                    yield pa.record_batch({"bucket": pa.array([k], pa.int32()), "sets": pa.array([every[used].tobytes()], pa.binary()), "tokens": pa.array([short.tobytes()], pa.binary()), "owners": pa.array([at.astype(np.uint16).tobytes()], pa.binary())})
            held.clear()
            digests.clear()

        waiting = 0
        for batch in batches:
            for _, tokens in _sets(batch, size):
                low = tokens[: np.searchsorted(tokens, np.int64(min(limit.low, FULL - 1)))]
                name = _digest(tokens, 0x9E37)
                if len(low) and name not in digests:
                    digests[name] = None
                    held.append(low)
                    waiting += len(low)
                    if waiting >= FLUSH_TOKENS or len(held) >= FLUSH_SETS:
                        yield from flush()
                        waiting = 0
        yield from flush()

    @tidied
    def count(group: pa.Table) -> pa.Table:
        tokens, sets = [], []
        for row in group.select(["sets", "tokens", "owners"]).to_pylist():
            short = np.frombuffer(row["tokens"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :5] = short
            tokens.append(wide.view("<i8").ravel())
            sets.append(np.frombuffer(row["sets"], np.int64)[np.frombuffer(row["owners"], np.uint16)])
        t, a = np.concatenate(tokens), np.concatenate(sets)
        order = np.argsort(t)
        t, a = t[order], a[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        several = np.minimum.reduceat(a, first) != np.maximum.reduceat(a, first)
        kept = np.repeat(several, np.diff(np.append(first, len(t))))
        t, a = t[kept], a[kept]
        order = np.lexsort((t, a))
        t, a = t[order], a[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]))) if len(t) else np.zeros(0, bool)
        names, n = np.unique(a[new], return_counts=True)
        part = (names.astype(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        names, n, part = names[order], n[order].astype(np.int32), part[order]
        every, at = np.unique(part, return_index=True)
        ends = np.append(at, len(part))  # a bucket in which nothing is shared has no part, and sends no row
        cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        packed = [pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in (names, n)]
        return pa.table({"part": pa.array(every, pa.int32()), "names": packed[0], "counts": packed[1]})

    @tidied
    def add(group: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group["names"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in group["counts"]])
        every, at = np.unique(names, return_inverse=True)
        return pa.table({"a": pa.array(every, pa.int64()), "shared": pa.array(np.bincount(at, n).astype(np.int64), pa.int64())})

    packed = documents.select("text").mapInArrow(pack, "bucket int, sets binary, tokens binary, owners binary")
    return packed.groupBy("bucket").applyInArrow(count, "part int, names binary, counts binary").groupBy("part").applyInArrow(add, "a long, shared long")


def blocks(documents: DataFrame, suspects: DataFrame, few: int, size: int, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c, t): the rarest shingles of `suspects` (doc_id, n) by size class; (id, component): the ties they make.

    Each doc_id of `documents` is there once: a repeated row would fill the prefix with repeats of one shingle.
    """

    @tidied
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tokens in _sets(batch, size):
                own = limit.sketch(tokens)
                k = len(own)
                yield pa.record_batch({"doc_id": pa.array(np.full(k, batch.column(0)[i].as_py(), np.int64)), "n": pa.array(np.full(k, len(tokens), np.int32)), "need": pa.array(np.full(k, len(tokens) - limit.least(len(tokens)) + 1, np.int32)), "t": pa.array(own)})

    texts = documents.join(small_side(suspects.select("doc_id"), few, FEW), "doc_id", "left_semi").select("doc_id", "text")
    postings = stored(texts.mapInArrow(sketches, "doc_id long, n int, need int, t long"), "postings")
    often = postings.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    # a global order: hash range, then rarest first, then the hash
    span = F.when(F.col("t") < limit.low, 0).when(F.col("t") < limit.mid, 1).otherwise(2) if limit.low < FULL - 1 else F.lit(0)
    ranked = postings.join(often, "t", "left").groupBy("doc_id").agg(
        F.first("need").alias("need"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(span.alias("r"), F.coalesce("df", F.lit(1)).alias("df"), "t"))).alias("ts")
    )
    kept = F.filter(F.slice("ts", F.lit(1), F.col("need")), lambda x: x["df"] > 1)
    kind = limit.size_class(F.col("n"))
    prefix = ranked.select("doc_id", kind.alias("c"), F.explode(F.transform(kept, lambda x: x["t"])).alias("t"))
    prefix = stored(prefix.select("doc_id", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c"), "t"), "prefix")
    least = prefix.groupBy("t", "c").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("_x")).where("m <> _x").drop("_x")
    ties = prefix.join(least, ["t", "c"]).where(F.col("doc_id") != F.col("m")).select(F.col("doc_id").alias("u"), F.col("m").alias("v")).distinct()
    return prefix, connected(ties)


class _Forest:
    """Which sets are connected. Sets of one label are so from the start."""

    def __init__(self):
        self.up: list[int] = []
        self.first: dict = {}

    def add(self, label) -> int:
        k = len(self.up)
        self.up.append(k if label is None else self.first.setdefault(label, k))
        return k

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


class Lists:
    """The inverted lists of some sets, and DivideSkip over them. Sets may ask one after the other, without end."""

    def __init__(self, sets: list[np.ndarray], labels: list, limit: Threshold):
        self.limit, self.n = limit, len(sets)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(tokens, kind="stable")  # each list's owners ascend
        self.owner = owner[order]
        self.every, self.starts, self.lengths = np.unique(tokens[order], return_index=True, return_counts=True)
        self.lists = np.repeat(np.arange(len(self.every)), self.lengths) * self.n + self.owner  # ascends: one array for all binary searches
        self.forest = _Forest()
        for label in labels:
            self.forest.add(label)

    def among(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links among the lists' own sets, each of them asked for the ones before it."""
        for q in range(1, self.n):
            yield from self.ask(sets[q], q, q)

    def ask(self, own: np.ndarray, q: int, before: int | None = None) -> Iterator[tuple[int, int]]:
        """(q, c) for links of the set `own`, node q of the forest, that connect more than is connected."""
        limit, n, within = self.limit, len(own), before is not None
        t = limit.least(n)
        if not len(self.every):
            return
        at = np.minimum(np.searchsorted(self.every, own), len(self.every) - 1)
        at = at[(self.every[at] == own) & (self.lengths[at] > within)]
        if len(at) < t:
            return
        at = at[np.argsort(self.lengths[at], kind="stable")]
        skip = min(t - 1, int(t / (SKIP * np.log2(max(2, self.lengths[at[-1]])) + 1)))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        # merge the short lists: each ascends, and a merge sort of their runs brings equal owners together
        place = np.repeat(self.starts[short] - np.concatenate(([0], np.cumsum(self.lengths[short])[:-1])), self.lengths[short])
        merged = np.sort(self.owner[place + np.arange(len(place))], kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        met, times = merged[heads], np.diff(np.append(heads, len(merged)))
        able = (times >= t - skip) & (self.sizes[met] * limit.den >= limit.num * n) & (self.sizes[met] * limit.num <= limit.den * n)
        if within:
            able &= met < before
        met, times = met[able], times[able]
        for k in np.argsort(-times, kind="stable").tolist():
            c, seen = int(met[k]), int(times[k])
            if self.forest.find(c) == self.forest.find(q):
                continue
            need = limit.overlap(n, int(self.sizes[c]))
            if seen + len(long) < need:
                continue
            probes = long * self.n + c
            hit = np.searchsorted(self.lists, probes)
            if seen + int((self.lists[np.minimum(hit, len(self.lists) - 1)] == probes).sum()) >= need:
                self.forest.join(c, q)
                yield q, c


def chunk_links(rows: DataFrame, size: int, limit: Threshold, tasks: int) -> DataFrame:
    """(u, v) from rows (block, chunk, asks, label, doc_id, text): each chunk is searched as a whole, by one task.

    A chunk's own sets are bounded and make its lists; sets that ask are read one after the other and not kept. The ends of
    a link are named by their labels, or by their doc_id where they have none.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, labels, sets, lists = None, [], [], [], None
        found: list[tuple[int, int]] = []

        def send() -> pa.RecordBatch:
            out = pa.record_batch({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})
            found.clear()
            return out

        def close() -> None:
            if lists is None and len(sets) > 1:  # nobody asks: the sets among themselves
                found.extend((names[q], names[c]) for q, c in Lists(sets, labels, limit).among(sets))

        for batch in batches:
            heads = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for i, tokens in _sets(batch, size):
                block, chunk, asks, label, doc = heads[i]
                if (block, chunk) != key:
                    close()
                    key, names, labels, sets, lists = (block, chunk), [], [], [], None
                name = doc if label is None else label
                if not asks:
                    names.append(name)
                    labels.append(label)
                    sets.append(tokens)
                elif sets:
                    if lists is None:
                        lists = Lists(sets, labels, limit)
                    q = lists.forest.add(label)
                    found.extend((name, names[c]) for _, c in lists.ask(tokens, q))
            if found:
                yield send()
        close()
        yield send()

    columns = ["block", "chunk", "asks", "label", "doc_id"]
    # a number of tasks of its own: what a chunk costs is not told by its bytes
    dealt = rows.select(*columns, "text").repartition(tasks, "block", "chunk").sortWithinPartitions("block", "chunk", "asks", "doc_id")
    return dealt.mapInArrow(run, "u long, v long")


def relabelled(labels: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """`labels` (id, component) after `more` (id, component) of about `n` rows tied some of its components, or ids it has not."""
    to = more.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    known = labels.join(small_side(to, n, FEW), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return known.unionByName(more.join(labels.select("id"), "id", "left_anti"))


def components_of_blocks(documents: DataFrame, prefix: DataFrame, tied: DataFrame, sizes: DataFrame, size: int, limit: Threshold, chunk_sets: int = CHUNK_SETS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(id, component) of what links connect, from blocks (id, component) and set sizes (doc_id, n).

    A set that asks goes only to the chunks that hold a set of another component with one of its rarest shingles.
    """
    own = tied.join(sizes, tied["id"] == sizes["doc_id"]).select("doc_id", "n", F.col("component").alias("block"))
    parts = own.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum("n") / chunk_tokens)).cast("int").alias("parts"))
    members = own.join(parts, "block").select("doc_id", "block", "parts", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("chunk"))
    members = stored(members, "members")
    count, large = members.agg(F.count("*"), F.coalesce(F.sum((F.col("parts") > 1).cast("int")), F.lit(0))).first()
    with_text = lambda rows, n: documents.select("doc_id", "text").join(small_side(rows, n, FEW), "doc_id")
    tasks = lambda n: max(1, -(-n // TASK_SETS))
    base = members.select("doc_id", "block", "chunk", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("label"))
    links = stored(chunk_links(with_text(base, count), size, limit, tasks(count)), "links")
    labels = connected(links)
    if not large:
        return labels
    members = stored(members.where("parts > 1"), "large-blocks")
    asked_before = None
    for step in ("one of each", "all the others"):
        marked = members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        marked = stored(marked, "marked")
        if step == "one of each":
            one = marked.groupBy("block", "chunk", "label").agg(F.min("doc_id").alias("doc_id"))
            asking = stored(one.select("doc_id"), "asking-ids")
            asked_before, lists = asking, prefix
        else:
            # a set that has asked met all its links; the largest component need not ask, as the others do
            largest = marked.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
            rest = marked.join(largest, "block").where("label <> largest").select("doc_id")
            asking = stored(rest.join(asked_before, "doc_id", "left_anti"), "asking-ids")
            if asking.isEmpty():
                break
            sought = prefix.join(asking, "doc_id", "left_semi").select("c", "t").distinct()
            lists = prefix.join(sought, ["c", "t"], "left_semi")
        # one row for each shingle and set; a list is known by its chunks and, in each, whether it has more than one component
        flagged = marked.join(asking.withColumn("asks", F.lit(True)), "doc_id", "left")
        held = stored(lists.join(flagged, "doc_id").select("c", "t", "doc_id", "block", "chunk", "label", "asks"), "lists")
        chunks = held.groupBy("c", "t", F.col("chunk").alias("to")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        met = held.where("asks").join(chunks, ["c", "t"]).where("to <> chunk and (lo <> label or hi <> label)")
        rows = met.select("doc_id", "block", F.col("to").alias("chunk"), F.lit(1).alias("asks"), "label").distinct()
        # only the chunks that are asked, each with the sets it holds
        asked = rows.select("block", "chunk").distinct()
        rows = stored(rows.unionByName(marked.join(asked, ["block", "chunk"], "left_semi").select("doc_id", "block", "chunk", F.lit(0).alias("asks"), "label")), "asking")
        n_rows = rows.count()
        found = stored(chunk_links(with_text(rows, n_rows), size, limit, tasks(n_rows)), "links")
        if n := found.count():
            labels = stored(relabelled(labels, connected(found), 2 * n), "labels")
    return labels


def similar(documents: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `documents` (doc_id, text): links at Jaccard num / den over `size` words."""
    documents, unique = identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "_id")
    if unique:
        return components(documents.drop("_id"), size, num, den)
    found = stored(components(documents.select(F.col("_id").alias("doc_id"), "text"), size, num, den).withColumnRenamed("doc_id", "_id"), "numbered")
    own = stored(documents.select("_id", "doc_id").join(found, "_id"), "named")
    # numbers ascend with doc_id: the row that names a component has its smallest
    names = own.where(F.col("_id") == F.col("component_id")).select("component_id", F.col("doc_id").alias("_name"))
    return own.join(names, "component_id").select("doc_id", "n_shingles", F.col("_name").alias("component_id"))


def components(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """`similar` of `documents` whose doc_ids are all there and distinct."""
    limit = Threshold(num, den)
    rows = stored(set_rows(documents, size, limit), "sets")
    classes = stored(rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("low").alias("low")), "classes")
    n_classes, tokens = classes.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0))).first()
    shared = shared_counts(documents, size, limit, max(1, -(-tokens // BUCKET_TOKENS)), max(1, -(-n_classes // PART_CLASSES)))
    spare = F.col("n") - F.ceil(F.col("n") * num / den)
    suspects = classes.join(shared, "a", "left").where(F.col("low") - F.coalesce("shared", F.lit(0)) <= spare)
    suspects = stored(suspects.select("doc_id", "n"), "suspects")
    prefix, tied = blocks(documents, suspects, suspects.count(), size, limit)
    found = components_of_blocks(documents, prefix, tied, suspects, size, limit).withColumnRenamed("id", "doc_id")
    named = classes.join(found, "doc_id", "left").select("n", "a", "b", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.join(named, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
