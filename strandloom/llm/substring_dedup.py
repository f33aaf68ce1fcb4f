"""Exact substring deduplication with suffix arrays.

A byte goes when some string of `width` bytes that covers it also starts in a document of smaller doc_id.

Candidate search. Each string of `width` bytes has an anchor: the `ANCHOR` bytes in it of smallest hash, leftmost among equal
ones. Equal strings have equal anchors at equal places, so a repeat shows as an anchor that two documents share.
Anchors are met in hash buckets as packed byte strings; those of one document only are dropped, and with them nearly all
unrepeated text.

Resolution. Documents lie in shards of bounded size. What their shared anchors leave of a shard's texts goes into a suffix
array: Larsson-Sadakane refinement in numpy, Kasai's common prefixes in text order, groups of equal strings read off where
the prefix reaches `width`. A group's smallest document keeps the string, so however common a passage is a shard sends
it on once, as stretches: the strings of one anchor, which follow each other. Across shards stretches meet by anchor. Of
equal ones (compared byte by byte) the smallest document decides; where an anchor has several, they go into arrays of at
most `ARRAY_BYTES`, merged by binary search of the groups' heads, and each group's smallest document decides.

Defined cases: a null text has 0 bytes, 0 removed, 0 spans and the digest of no bytes. Texts shorter than `width` keep
all. Of equal texts the smallest doc_id is the original; the copies go whole. Rows that repeat a doc_id with its text are
one document and get equal rows. Where a doc_id is null or has several texts, each of its texts is a document of its own;
they are ordered by doc_id (nulls last), then by a hash of the text, and the later loses what the earlier holds. Extra
columns are ignored; empty tables give no rows. Texts are bytes; a cut may part a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import identified, mixed, slices, small_side, span_hashes, stored, utf8

WIDTH = 50
ANCHOR = 24
PIECE = 1 << 20
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
ARRAY_BYTES = 1 << 20
FLUSH_ANCHORS = 2 << 20
FLUSH_DOCS = 20_000
FEW, FEW_FATES, FEW_BYTES = 1_000_000, 400_000, 32 << 20

_PLACE = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, first byte highest; shorter by 7."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


def stretches(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, anchor): runs of strings (by their starts) of one anchor, within rows, in order; anchor as 63-bit hash."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none
    words = _words8(data)
    anchor = max(8, min(ANCHOR, width // 2 // 8 * 8))
    n = len(words) - (anchor - 8)
    hashes = words[:n].copy()
    for k in range(8, anchor, 8):
        hashes = mixed(hashes) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    hashes = mixed(hashes)
    least = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = width - anchor + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    lengths = np.diff(offsets)
    firsts = _ranges(offsets[:-1][lengths >= width], lengths[lengths >= width] - width + 1)
    if not len(firsts):
        return none, none, none
    places = (least[firsts] & _PLACES).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (places[1:] != places[:-1]) | (firsts[1:] != firsts[:-1] + 1))))
    return firsts[new], np.diff(np.append(new, len(firsts))), (hashes[places[new]] >> np.uint64(1)).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, start in it, bytes, offsets): bounded pieces; those of one long row overlap by width - 1 bytes."""
    for i, j in slices(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= PIECE:
            yield i, 0, data[a:b], offsets[i : j + 1] - a
        else:
            for at in range(a, max(a + 1, b - width + 1), PIECE):
                part = data[at : min(b, at + PIECE + width - 1)]
                yield i, at - a, part, np.array([0, len(part)])


def _keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What of an anchor travels: its bucket and 40 bits more."""
    return (tokens // buckets & ((1 << 40) - 1)) * buckets + tokens % buckets


def _by(names: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(name, columns...) for each run of equal `names`, in their order; nothing for none."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(names)), bool), names[1:] != names[:-1])))
    ends = np.append(at, len(names))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield int(names[i]), *(x[i:j] for x in columns)


def shared_anchors(documents: DataFrame, buckets: int, shards: int, width: int) -> DataFrame:
    """(shard, docs, keys): packed pairs of a document and an anchor that it shares with another document.

    Anchors that documents of one task share are known there: these pairs go on to their shards, and only the anchor's
    least and greatest document meet those of other tasks. So an anchor's bucket gets two pairs a flush, however common it is.
    """
    schema = "bucket int, shard int, docs binary, owners binary, keys binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not docs:
                return
            d, k = np.concatenate(docs), np.concatenate(keys)
            docs.clear()
            keys.clear()
            if not len(d):
                return
            order = np.lexsort((d, k))
            d, k = d[order], k[order]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            last = np.append(first[1:], True)
            heads = np.flatnonzero(first)
            several = np.repeat(d[heads] != d[np.flatnonzero(last)], np.diff(np.append(heads, len(k))))
            own, at = d[several], k[several]
            shard = _shard(own, shards)
            order = np.argsort(shard, kind="stable")
            for s, part, tokens in _by(shard[order], own[order], at[order]):
                names, owner = np.unique(part, return_inverse=True)
                yield row(s % buckets, s, names, owner, tokens.astype("<i8"))
            met = first | (last & several)
            d, k = d[met], k[met]
            order = np.argsort(k % buckets, kind="stable")
            d, k = d[order], k[order]
            for b, part, tokens in _by(k % buckets, d, k):
                names, owner = np.unique(part, return_inverse=True)
                yield row(b, None, names, owner, (tokens // buckets).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5])

        def row(bucket: int, shard: int | None, names: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
            blobs = (names.tobytes(), owner.astype(np.uint16).tobytes(), tokens.tobytes())
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["bucket", "shard", "docs", "owners", "keys"])

        waiting = rows = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, _, part, at in _pieces(data, offsets, width):
                first, _, tokens = stretches(part, at, width)
                own = i + np.searchsorted(at, first, "right") - 1
                k = _keys(tokens, buckets)
                order = np.lexsort((k, own))
                own, k = own[order], k[order]
                new = np.concatenate((np.ones(min(1, len(k)), bool), (own[1:] != own[:-1]) | (k[1:] != k[:-1])))
                docs.append(ids[own[new]])
                keys.append(k[new])
                waiting += int(new.sum())
                rows += len(at) - 1
                if waiting >= FLUSH_ANCHORS or rows >= FLUSH_DOCS:
                    yield from flush()
                    waiting = rows = 0
        yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        docs, keys, out = [], [], []
        for row in group.to_pylist():
            own = np.frombuffer(row["docs"], np.int64)[np.frombuffer(row["owners"], np.uint16)]
            if row["shard"] is not None:
                out.append((row["shard"], own, np.frombuffer(row["keys"], np.int64)))
                continue
            short = np.frombuffer(row["keys"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :5] = short
            keys.append(wide.view("<i8").ravel() * buckets + row["bucket"])
            docs.append(own)
        if keys:
            k, d = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(k)
            k, d = k[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            several = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(k))))
            k, d = k[several], d[several]
            shard = _shard(d, shards)
            order = np.argsort(shard, kind="stable")
            out += _by(shard[order], d[order], k[order])
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "docs": pa.array([x[1].tobytes() for x in out], pa.binary()), "keys": pa.array([x[2].tobytes() for x in out], pa.binary())})

    packed = documents.mapInArrow(pack, schema)
    return packed.groupBy("bucket").applyInArrow(meet, "shard int, docs binary, keys binary")


def _shard(doc_ids: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(doc_ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of `text`, by Larsson-Sadakane: 8 bytes first, then groups still tied are refined.

    Each round sorts only the suffixes in groups of two or more, by the rank of the suffix as many bytes further on as
    the groups agree in, until no group is left.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = _words8(np.concatenate((text, np.zeros(7, np.uint8))))
    order = np.argsort(word)
    word = word[order]
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    size = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    depth = 8
    while len(tied):
        at = order[tied]
        further = at + depth
        # a suffix that ends goes before one that goes on, the shorter first: a byte of 0 is no end
        key = rank[at] * np.int64(n + depth + 1) + np.where(further < n, rank[np.minimum(further, n - 1)] + depth + 1, n - at)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's array: how many bytes each suffix in `order` shares with the one before it; 0 for the first.

    Taken in text order: where the suffix one place to the left has the neighbour one place to the left too, and they
    begin with the same byte, the prefix is one shorter, so only the first of such a run is compared; 8 bytes a step.
    """
    n = len(text)
    if not len(order):
        return np.zeros(0, np.int64)
    other = np.full(n, -1, np.int64)
    other[order[1:]] = order[:-1]
    head = np.concatenate(([True], (other[1:] != other[:-1] + 1) | (other[:-1] < 0) | (text[:-1] != text[other[:-1]])))
    heads = np.flatnonzero(head)
    run = np.diff(np.append(heads, n))
    i, j = heads, other[heads]
    word = _words8(np.concatenate((text, np.zeros(7, np.uint8))))
    got = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(j >= 0)
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        room = n - np.maximum(a, b)
        differ = word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)]
        same = (differ == 0).astype(np.int64)
        for k in range(8, 64, 8):
            same += differ < np.uint64(1 << k)
        got[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]
    return np.maximum(np.repeat(got, run) - _ranges(np.zeros(len(run), np.int64), run), 0)[order]


def suffix_groups(text: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in suffix order, and where a new string of `width` bytes begins among them.

    Every suffix asked for has `width` bytes. Two of them share what the least of the prefixes between them says.
    """
    order = suffix_array(text)
    asked = np.zeros(len(text), bool)
    asked[starts] = True
    at = np.flatnonzero(asked[order])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    shared = common_prefixes(text, order)[: at[-1] + 1]
    least = np.minimum.reduceat(shared, np.concatenate(([0], at[:-1] + 1)))
    fresh = least < width
    fresh[0] = True
    return order[at], fresh


class _Contexts:
    """Stretches with their bytes: doc, first string's start in it, number of strings, anchor key."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, docs, starts, counts, keys, text):
        if len(docs):
            self.parts.append((docs, starts, counts, keys, text))

    def all(self, width: int):
        if not self.parts:
            z = np.zeros(0, np.int64)
            return z, z, z, z, np.zeros(0, np.uint8), z, z
        docs, starts, counts, keys, text = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(counts + width - 1)
        begins = ends - (counts + width - 1)
        return docs, starts, counts, keys, text, begins, ends


class _Texts:
    """What an array is built of: pieces of documents (doc, start, strings, bytes), each of one stretch or several in a row.

    Stretches are known by their piece, the place of their first string in it, their number of strings and their key.
    """

    def __init__(self):
        self.pieces: list[tuple] = []
        self.stretches: list[tuple] = []
        self.n = self.size = 0

    def add(self, docs, starts, first, count, keys, own, data, width: int) -> None:
        """Stretches in order of place; `own` tells the rows of `data` apart, `starts` are places in the document."""
        head = np.concatenate(([True], (own[1:] != own[:-1]) | (first[1:] != first[:-1] + count[:-1])))
        heads = np.flatnonzero(head)
        piece = np.cumsum(head) - 1
        strings = np.add.reduceat(count, heads)
        text = data[_ranges(first[heads], strings + width - 1)]
        self.pieces.append((docs[heads], starts[heads], strings, text))
        self.stretches.append((self.n + piece, first - first[heads][piece], count, keys))
        self.n += len(heads)
        self.size += len(text)

    def resolve(self, width: int):
        """What goes by this array (docs, starts, ends), and the stretches left that hold a string of its first document.

        Strings are grouped in suffix order; each goes where its group has a smaller document.
        """
        docs, starts, counts, text = (np.concatenate(x) for x in zip(*self.pieces, strict=True))
        piece, place, strings, keys = (np.concatenate(x) for x in zip(*self.stretches, strict=True))
        begins = np.cumsum(counts + width - 1) - (counts + width - 1)
        first = np.cumsum(counts) - counts
        at = _ranges(begins, counts)
        doc = np.repeat(docs, counts)
        suffixes, fresh = suffix_groups(text, at, width)
        of = np.searchsorted(at, suffixes)
        heads = np.flatnonzero(fresh)
        least = np.empty(len(at), np.int64)
        least[of] = np.repeat(np.minimum.reduceat(doc[of], heads), np.diff(np.append(heads, len(of))))
        gone = least < doc
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        new[first] = gone[first]
        last = gone.copy()
        last[:-1] &= ~gone[1:] | new[1:]
        i, j = np.flatnonzero(new), np.flatnonzero(last)
        own = np.searchsorted(first, i, "right") - 1
        cut = docs[own], starts[own] + i - first[own], starts[own] + j + 1 - first[own] + width - 1
        kept = np.concatenate(([0], np.cumsum(~gone)))
        begin = first[piece] + place
        left = np.flatnonzero(kept[begin + strings] > kept[begin])
        piece, place, strings = piece[left], place[left], strings[left]
        return cut, (docs[piece], starts[piece] + place, strings, keys[left], text, begins[piece] + place, begins[piece] + place + strings + width - 1)


def _named(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches ordered by key and content, then document; where a content begins; each content's smallest document.

    Contents are ordered by a fingerprint and then compared byte by byte with the first of their fingerprint.
    """
    lengths = ends - begins
    prints = np.zeros(len(docs), np.uint64)
    for i, j in slices(np.append(begins, ends[-1:]), PIECE):
        prints[i:j] = span_hashes(text[begins[i] : ends[j - 1]], begins[i:j] - begins[i], ends[i:j] - begins[i])
    prints = mixed(prints + mixed(lengths.astype(np.uint64)))
    while True:
        order = np.lexsort((docs, prints, keys))
        k, p = keys[order], prints[order]
        new = np.concatenate((np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
        heads = np.flatnonzero(new)
        like = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
        other = lengths[order] != lengths[like]
        check = np.flatnonzero((order != like) & ~other)
        total = np.concatenate(([0], np.cumsum(lengths[order[check]])))
        for i, j in slices(total, PIECE):
            a, b = order[check[i:j]], like[check[i:j]]
            differ = text[_ranges(begins[a], lengths[a])] != text[_ranges(begins[b], lengths[b])]
            other[check[i:j]] = np.logical_or.reduceat(differ, total[i:j] - total[i])
        if not other.any():
            return order, new, docs[order][heads]
        prints[order[other]] = mixed(prints[order[other]] + np.uint64(1))  # one fingerprint, two contents


def _sent(docs, starts, ends, shards: int) -> pa.RecordBatch:
    """Removed spans on their way to the documents' shards: one packed row a shard."""
    shard = _shard(docs, shards)
    order = np.lexsort((starts, docs, shard))
    packed = np.stack((docs, starts, ends), axis=1).astype(np.int64)[order]
    out = [(s, x.tobytes()) for s, x in _by(shard[order], packed)]
    return pa.record_batch({"shard": pa.array([s for s, _ in out], pa.int32()), "spans": pa.array([x for _, x in out], pa.binary())})


def _cuts(group: pa.Table) -> pa.Table:
    """One row a document: its removed spans, merged, as packed pairs."""
    docs, starts, ends = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in group["spans"].to_pylist()]).T
    order = np.lexsort((starts, docs))
    out = [(d, _merged(a, b).tobytes()) for d, a, b in _by(docs[order], starts[order], ends[order])]
    return pa.table({"_id": pa.array([d for d, _ in out], pa.int64()), "cuts": pa.array([x for _, x in out], pa.binary())})


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of spans, ordered by start, as rows (start, end); touching spans are one."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack((starts[new], reach[last]), axis=1).astype(np.int64)


def _blobs(docs, starts, counts, keys, text, begins, ends) -> dict:
    return {"docs": docs.astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(), "counts": counts.astype(np.int32).tobytes(), "keys": keys.astype(np.int64).tobytes(), "bytes": text[_ranges(begins, ends - begins)].tobytes()}


def shard_stretches(documents: DataFrame, anchors: DataFrame, buckets: int, shards: int, width: int) -> DataFrame:
    """Rows of two kinds: (shard, spans) resolved within a shard, and packed stretches by bucket for the rest."""
    schema = "shard int, spans binary, bucket int, docs binary, starts binary, counts binary, keys binary, bytes binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shard(batch.column(0).to_numpy(zero_copy_only=False), shards)), *batch.columns], names=["shard", "_id", "text"])

    texts = documents.mapInArrow(place, "shard int, _id long, text string").select("shard", F.lit(1).alias("kind"), "_id", "text", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("keys"))
    pairs = anchors.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast("string").alias("text"), "docs", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pairs, prints, found = None, [], None, _Texts()

        def close() -> Iterator[pa.RecordBatch]:
            if not found.n:
                return
            cut, (docs, starts, counts, keys, text, begins, ends) = found.resolve(width)
            if len(cut[0]):
                sent = _sent(*cut, shards)
                yield pa.RecordBatch.from_arrays([*sent.columns, *(pa.nulls(sent.num_rows, t) for t in (pa.int32(), *[pa.binary()] * 5))], names=names)
            bucket = keys % buckets
            order = np.argsort(bucket, kind="stable")
            for b, own in _by(bucket[order], order):
                blobs = _blobs(docs[own], starts[own], counts[own], keys[own], text, begins[own], ends[own])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), *(pa.array([blobs[x]], pa.binary()) for x in names[3:])], names=names)

        for batch in batches:
            heads = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (heads[0][1:] != heads[0][:-1]) | (heads[1][1:] != heads[1][:-1])))) if batch.num_rows else []
            for i, j in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                part = batch.slice(i, j - i)
                if heads[0][i] != shard:
                    yield from close()
                    shard, pairs, prints, found = heads[0][i], [], None, _Texts()
                if heads[1][i] == 0:
                    for d, k in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                        pairs.append(mixed(np.frombuffer(d, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.frombuffer(k, np.uint64)))
                    continue
                if prints is None:
                    prints = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
                    pairs = []
                if not len(prints):
                    continue
                ids = part.column(2).to_numpy(zero_copy_only=False)
                data, offsets = utf8(part.column(3))
                for row, start, piece, at in _pieces(data, offsets, width):
                    first, count, tokens = stretches(piece, at, width)
                    if not len(first):
                        continue
                    own = np.searchsorted(at, first, "right") - 1
                    docs, keys = ids[row + own], _keys(tokens, buckets)
                    mark = mixed(docs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + keys.astype(np.uint64))
                    kept = prints[np.minimum(np.searchsorted(prints, mark), len(prints) - 1)] == mark
                    if kept.any():
                        first, count, own = first[kept], count[kept], own[kept]
                        found.add(docs[kept], first - at[own] + start, first, count, keys[kept], own, piece, width)
                    if found.size >= SHARD_BYTES:  # a long text: what is left meets across arrays as it does across shards
                        yield from close()
                        found = _Texts()
        yield from close()

    dealt = pairs.unionByName(texts).repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, schema)


def resolve(docs, starts, counts, keys, text, begins, ends, width: int, array_bytes: int = ARRAY_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, starts, ends) of what goes, from stretches that hold all strings of their anchors."""
    if not len(docs):
        return docs, starts, ends
    order, new, least = _named(text, begins, ends, keys, docs)
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(order)))
    whole = docs[order] > np.repeat(least, size)
    out = [(docs[order[whole]], starts[order[whole]], (starts + counts)[order[whole]] + width - 1)]
    # contents of anchors that have more than one
    first = order[heads]
    several = np.zeros(len(first), bool)
    if len(first) > 1:
        alike = keys[first][1:] == keys[first][:-1]
        several[1:] |= alike
        several[:-1] |= alike
    mine = np.flatnonzero(several)
    arrays, k = [], 0
    while k < len(mine):
        # an array's worth of contents
        total = np.cumsum((ends - begins)[first[mine[k:]]])
        part = mine[k : k + max(1, int(np.searchsorted(total, array_bytes, "right")))]
        k += len(part)
        at = first[part]
        length = ends[at] - begins[at]
        own = text[_ranges(begins[at], length)]
        lead = np.cumsum(length) - length
        strings = _ranges(lead, counts[at])
        doc = np.repeat(least[part], counts[at])
        suffixes, fresh = suffix_groups(own, strings, width)
        group = np.flatnonzero(fresh)
        of = np.searchsorted(strings, suffixes)
        best = np.minimum.reduceat(doc[of], group)
        head = np.ascontiguousarray(own[suffixes[group][:, None] + np.arange(width)]).view(f"S{width}").ravel()
        arrays.append((part, strings, of, np.repeat(np.arange(len(group)), np.diff(np.append(group, len(suffixes)))), head, best))
    # merge the arrays: heads of one are looked up in what the others have
    if len(arrays) > 1:
        every, smallest = arrays[0][4], arrays[0][5].copy()
        for *_, head, best in arrays[1:]:
            at = np.searchsorted(every, head)
            hit = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == head)
            np.minimum.at(smallest, at[hit], best[hit])
            every, smallest = np.insert(every, at[~hit], head[~hit]), np.insert(smallest, at[~hit], best[~hit])
        arrays = [(*x[:5], smallest[np.searchsorted(every, x[4])]) for x in arrays]
    for part, strings, of, group, _, best in arrays:
        decided = np.empty(len(strings), np.int64)
        decided[of] = best[group]
        at = first[part]
        lead = np.cumsum(counts[at]) - counts[at]
        for p, i, n in zip(part.tolist(), lead.tolist(), counts[at].tolist(), strict=True):
            gone = np.flatnonzero(decided[i : i + n] < least[p])
            if len(gone):
                # every stretch of this content in its smallest document
                own = order[heads[p] : heads[p] + size[p]]
                own = own[docs[own] == least[p]]
                for s in own.tolist():
                    out.append((np.full(len(gone), docs[s]), starts[s] + gone, starts[s] + gone + width))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cross_shard(rows: DataFrame, shards: int, width: int) -> DataFrame:
    """(shard, spans) from the stretches that the shards passed on, a bucket a task."""

    def run(group: pa.Table) -> pa.Table:
        found = _Contexts()
        for row in group.to_pylist():
            read = lambda name, kind: np.frombuffer(row[name], kind)
            found.add(read("docs", np.int64), read("starts", np.int64), read("counts", np.int32).astype(np.int64), read("keys", np.int64), read("bytes", np.uint8))
        return pa.Table.from_batches([_sent(*resolve(*found.all(width), width), shards)])

    columns = ["bucket", "docs", "starts", "counts", "keys", "bytes"]
    return rows.where("bucket is not null").select(*columns).groupBy("bucket").applyInArrow(run, "shard int, spans binary")


def deduplicate(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of `documents` (doc_id, text); `kept` is what remains."""
    documents, unique = identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "_id")
    sized = documents.select("_id", "doc_id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("name"))
    sized = stored(sized.where(F.col("n") >= width), "names")
    # rows are numbered in order of doc_id: the first row of a text has its smallest
    firsts = sized.groupBy("name").agg(F.min("_id").alias("first"), F.min_by("doc_id", "_id").alias("first_doc"), F.max("n").alias("n"), F.count("*").alias("copies"))
    firsts = stored(firsts, "originals")
    count, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = documents.join(small_side(firsts.select(F.col("first").alias("_id")), count, FEW), "_id", "left_semi").where(F.octet_length("text") >= width).select("_id", "text")
    buckets, shards = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // SHARD_BYTES))
    anchors = shared_anchors(texts, buckets, shards, width)
    met = stored(shard_stretches(texts, anchors, buckets, shards, width), "stretches")
    spans = met.where("shard is not null").select("shard", "spans").unionByName(cross_shard(met, shards, width))
    cuts = spans.groupBy("shard").applyInArrow(_cuts, "_id long, cuts binary")
    copies = sized.join(firsts.where("copies > 1").select("name", "first", "first_doc"), "name").where("_id <> first")
    if not unique:
        cuts = stored(cuts, "cuts")
    fates = cuts.select("_id", F.lit(False).alias("copy"), "cuts")
    if not unique:  # rows of one doc_id and text are one document
        again = copies.where(F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("_id", "first")
        fates = fates.unionByName(again.join(cuts.withColumnRenamed("_id", "first"), "first").select("_id", F.lit(False).alias("copy"), "cuts"))
        copies = copies.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    fates = fates.unionByName(copies.select("_id", F.lit(True).alias("copy"), F.lit(None).cast("binary").alias("cuts")))
    fates = stored(fates, "fates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = ([], [], [], [], [])
            for i, (copy, cuts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                spans = np.array([[0, len(text)]]) if copy else np.zeros((0, 2), np.int64)
                if cuts:
                    spans = np.frombuffer(cuts, np.int64).reshape(-1, 2)
                gaps = zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(text)], strict=True)
                kept = b"".join(text[a:b].tobytes() for a, b in gaps)
                for column, value in zip(out, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    n, size = fates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("cuts")), F.lit(0))).first()
    small = n if size <= FEW_BYTES else FEW_FATES + 1
    joined = documents.join(small_side(fates, small, FEW_FATES), "_id", "left").select("doc_id", "text", "copy", "cuts")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
