"""Cross-tokenizer alignment: which tokens of vocabulary A lie on which tokens of vocabulary B, over a whole corpus.

A document is tokenised twice. Byte offsets where a token of A and a token of B both end cut it into groups; within a
group every A token is linked with every B token whose bytes overlap its own, which is a walk of one link less than the
group has tokens. A group is named by its ids (`a1,a2|b1`), and ids settle lengths and so links. The corpus has far fewer distinct
groups than groups:

1. documents become (group, times) lists, stored once, and the lists are summed into the dictionary of distinct groups;
2. each distinct group is expanded into its links once, and links times the group's frequency add up to counts of pairs;
3. the pairs' counts are summed up by group again (links, links of the best count, sum of counts);
4. documents get their figures by joining their lists with the groups.

Joins by group and by pair broadcast what is frequent (more than 1 / `HOT_GROUPS` or 1 / `HOT_PAIRS` of the rows, so a bounded number of
keys) and shuffle the rest, so a group that every document holds is no task of its own. Pairs are bounded by the vocabularies.

Texts are tokenised whole and grouped in slices of texts: shared ends by a search in sorted offsets, equal groups by hash and comparison.
A's merges are run by tiktoken, several times faster than its own library; the tests hold its ids against that library's.

Defined cases: null and empty texts, and texts that the tokens of A or of B do not spell (a U+2581, which B reads as
a space), have no tokens: zeros and an empty digest. Rows that repeat a doc_id count each. Empty tables give no rows. Extra columns
but the text are kept; those of the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import hot_join, mixed, slices, stored, utf8

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 0x9E3779B97F4A7C15
HOT_GROUPS, HOT_PAIRS = 1 << 17, 1 << 14
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

_MARK = "\u2581"
# Fixed value: what byte-level vocabularies split texts by before they merge.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes are themselves, the others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens(NamedTuple):
    """Both tokenizers, and the bytes, lengths and decimal names of their ids."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    lengths_a: np.ndarray
    lengths_b: np.ndarray

    @staticmethod
    def load(a: bytes, b: bytes) -> Tokens:
        """A from a byte-level BPE's JSON file (its ids are in the order of its merges), B from a sentencepiece model."""
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        model = json.loads(a)
        special = {x["content"] for x in model["added_tokens"]}  # their strings inside texts are plain text
        ranks = {bytes(map(letters.__getitem__, piece)): k for piece, k in model["model"]["vocab"].items() if piece not in special}
        first = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        of_a = [b""] * (max(ranks.values()) + 1)
        for raw, k in ranks.items():
            of_a[k] = raw
        second = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [second.id_to_piece(k) for k in range(len(second))]
        of_b = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else b"" if second.is_control(k) or second.is_unknown(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        return Tokens(first, second, of_a, of_b, np.array(list(map(len, of_a))), np.array(list(map(len, of_b))))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of space and text in A, and of text in B, which adds the space; None where either does not spell it."""
        found = []
        for text, theirs in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = (" " + text).encode()
            ours = self.a.encode_ordinary(" " + text) if text else []
            right = text and b"".join([self.bytes_b[k] for k in theirs]) == raw == self.a.decode_bytes(ours)
            found.append((ours, theirs) if right else None)
        return found

    def links(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
        """The overlapping pairs of one group."""
        i = j = 0
        end_a, end_b = len(self.bytes_a[a[0]]), len(self.bytes_b[b[0]])
        while True:
            yield a[i], b[j]
            if end_a == end_b:
                return
            if end_a < end_b:
                i += 1
                end_a += len(self.bytes_a[a[i]])
            else:
                j += 1
                end_b += len(self.bytes_b[b[j]])


_loaded: dict[tuple[int, int], Tokens] = {}


def _tokens(shared: tuple) -> Tokens:
    """The tokenizers of two broadcast files, loaded once a Python worker."""
    key = (hash(shared[0].value), hash(shared[1].value))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokens.load(*(x.value for x in shared))
    return _loaded[key]


def _files(rows: DataFrame, a: str, b: str) -> tuple:
    """Both vocabularies, read once here: executors need no copy of the files."""
    found = []
    for path in (a, b):
        with open(path, "rb") as f:
            found.append(rows.sparkSession.sparkContext.broadcast(f.read()))
    return tuple(found)


class Groups(NamedTuple):
    """The groups of some texts: tokens before each one's end, and for each the number of its like among the distinct `names`."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    like: np.ndarray
    names: list[str]


def _flat(ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The token numbers of groups `which`, one after the other."""
    first = np.concatenate(([0], ends[:-1]))[which]
    n = ends[which] - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def grouped(a: np.ndarray, b: np.ndarray, tokens: Tokens, seed: int = SEED) -> Groups:
    """Groups of ids that spell the same bytes, equal ones told by hash and then compared id by id."""
    if not len(a):
        return Groups(*np.zeros((3, 0), np.int64), [])
    at_a, at_b = np.cumsum(tokens.lengths_a[a]), np.cumsum(tokens.lengths_b[b])
    place = np.searchsorted(at_b, at_a)
    both = at_b[place] == at_a
    ends_a, ends_b = np.flatnonzero(both) + 1, place[both] + 1
    hashes = np.zeros(len(ends_a), np.uint64)
    for ids, ends in ((a, ends_a), (b, ends_b)):
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        inside = np.arange(len(ids)) - np.repeat(starts, ends - starts)
        each = mixed((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(seed) + inside.astype(np.uint64))
        hashes = mixed(hashes * np.uint64(seed | 1) + np.add.reduceat(each, starts) + (ends - starts).astype(np.uint64))
    _, first, like = np.unique(hashes, return_index=True, return_inverse=True)
    for ids, ends in ((a, ends_a), (b, ends_b)):
        n = np.diff(ends, prepend=0)
        if (n != n[first][like]).any() or (ids != ids[_flat(ends, first[like])]).any():  # two groups of one hash
            return grouped(a, b, tokens, seed + 2)
    names = []
    left, right = a.tolist(), b.tolist()
    for g in first.tolist():
        x, y = (0, 0) if g == 0 else (ends_a[g - 1], ends_b[g - 1])
        names.append(f"{','.join(map(str, left[x : ends_a[g]]))}|{','.join(map(str, right[y : ends_b[g]]))}")
    return Groups(ends_a, ends_b, like, names)


def tokenised(documents: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, text: str = "text") -> DataFrame:
    """Stored: _kept holds the columns of `documents` but the text, _row tells rows apart, _groups and _times are its distinct groups."""
    shared = _files(documents, a, b)
    kept = [c for c in documents.columns if c != text and c not in MADE]
    rows = documents.select(F.struct(*kept).alias("_kept"), F.col(text).alias("_text"))  # whatever the columns are called
    kind = T.StructType([rows.schema[0]])
    for name in MADE[:3]:
        kind = kind.add(name, "long")
    kind = kind.add("groups_sha256", "string").add("_groups", T.ArrayType(T.StringType(), False)).add("_times", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                own = tokens.encode([t or "" for t in part.column(1).to_pylist()])
                spelt = [k for k, x in enumerate(own) if x]
                n = np.array([[len(own[k][0]), len(own[k][1])] for k in spelt], np.int64).reshape(-1, 2)
                a, b = (np.fromiter(chain.from_iterable([own[k][side] for k in spelt]), np.int64, int(n[:, side].sum())) for side in (0, 1))
                found = grouped(a, b, tokens)
                bounds = np.searchsorted(found.ends_a, np.cumsum(n[:, 0]), "right")  # a text's end is a group's
                firsts = np.concatenate(([0], bounds[:-1])).astype(np.int64)[: len(bounds)]
                numbers = np.zeros((3, len(own)), np.int64)
                numbers[0, spelt], numbers[1, spelt], numbers[2, spelt] = n[:, 0], n[:, 1], bounds - firsts
                digests, named = [""] * len(own), np.array(found.names, object)[found.like]
                for k, x, y in zip(spelt, firsts.tolist(), bounds.tolist(), strict=True):
                    digests[k] = hashlib.sha256(";".join(named[x:y].tolist()).encode()).hexdigest()
                of = np.repeat(np.array(spelt, np.int64), bounds - firsts)
                both, times = np.unique(of * max(1, len(found.names)) + found.like, return_counts=True)
                text_of, which = np.divmod(both, max(1, len(found.names)))
                at = pa.array(np.searchsorted(text_of, np.arange(len(own) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(found.names, pa.string()).take(pa.array(which))), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, numbers), pa.array(digests, pa.string()), *lists], names=kind.names)

    return stored(rows.mapInArrow(run, kind).withColumn("_row", F.monotonically_increasing_id()), "tokenised")


def dictionary(rows: DataFrame) -> DataFrame:
    """The distinct groups of tokenised rows, and how often each occurs."""
    return rows.select(F.explode(F.arrays_zip("_groups", "_times")).alias("x")).groupBy(F.col("x._groups").alias("group")).agg(F.sum("x._times").alias("frequency"))


def links(groups: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Each distinct group's linked pairs (a, b), how often it holds each, and its frequency."""
    shared = _files(groups, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared)
        for batch in batches:
            at, left, right, held = [], [], [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                ours, theirs = ([int(x) for x in side.split(",")] for side in name.split("|"))
                for (x, y), n in Counter(tokens.links(ours, theirs)).items():
                    at.append(k)
                    left.append(x)
                    right.append(y)
                    held.append(n)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(held, pa.int32())], names=["group", "frequency", "a", "b", "held"])

    return groups.select("group", "frequency").mapInArrow(run, "group string, frequency long, a int, b int, held int")


def pair_counts(expanded: DataFrame) -> DataFrame:
    """Each linked pair of ids with its links in the corpus, and whether no other A id has more links with this B id."""
    pairs = expanded.groupBy("a", "b").agg(F.sum(F.col("held") * F.col("frequency")).alias("count"), F.count("*").alias("_groups"))
    most = F.max("count").over(Window.partitionBy("b"))  # at most one row an id of A
    return pairs.withColumn("best", F.col("count") == most)


class Alignment(NamedTuple):
    """Figures of documents, distinct groups with theirs, and pairs of ids with their counts."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


def align(documents: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, text: str = "text") -> Alignment:
    rows = tokenised(documents, a, b, text)
    words = stored(dictionary(rows), "groups")
    expanded = stored(links(words, a, b), "links")
    pairs = stored(pair_counts(expanded), "pairs")
    total = expanded.count()
    met = hot_join(expanded, pairs, ["a", "b"], F.col("_groups") > total // HOT_PAIRS)
    held = F.col("held")
    figures = met.groupBy("group", "frequency").agg(F.sum(held).alias("links"), F.sum(F.when(F.col("best"), held).otherwise(0)).alias("best"), F.sum(held * F.col("count")).alias("counts"))
    figures = stored(figures, "figures")
    occurrences = rows.select("_row", F.explode(F.arrays_zip("_groups", "_times")).alias("x")).select("_row", F.col("x._groups").alias("group"), F.col("x._times").alias("n"))
    all_of = figures.agg(F.coalesce(F.sum("frequency"), F.lit(0))).first()[0]
    found = hot_join(occurrences, figures, ["group"], F.col("frequency") > all_of // HOT_GROUPS)
    n = F.col("n")
    sums = found.groupBy("_row").agg(F.sum(n * F.col("links")).alias("n_links"), F.sum(n * F.col("best")).alias("n_best"), F.sum(n * F.col("counts")).alias("count_sum"))
    plain = rows.drop("_groups", "_times")
    no = F.lit(0).cast("long")
    result = plain.join(sums, "_row", "left").select("_kept.*", *MADE[:3], *(F.coalesce(c, no).alias(c) for c in MADE[3:6]), MADE[6])
    return Alignment(result, figures, pairs.drop("_groups"))
