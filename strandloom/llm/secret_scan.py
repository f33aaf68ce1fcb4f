"""Secret scans: fixed patterns, and the token-efficiency test for random strings the patterns miss.

A byte-pair vocabulary packs ordinary words into few tokens and random strings into many, so a long unbroken
string of few characters per token is likely a key. Strings shorter than `LONG` must lie under a lower ratio, as few
tokens say less. Digests (plain hex of a digest's length), UUIDs, dates with times and plain numbers are excluded first.
What looks like an identifier (runs of letters or of digits joined by separators) is judged by its letter runs alone.

Defined cases: null text is empty; it has no spans and the digest of the empty list. Spans are code points, end
exclusive. Texts are scanned and strings tokenised whole, whatever their length; the spans of repeated rows are equal. Extra columns are kept; those
of the result's names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RATIO, SHORT_RATIO = 2.2, 1.8
SHORTEST, LONG = 12, 20
RUN = 3

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "random")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*")
_STAMP = re.compile(r"[0-9]{4}[-_/]?[0-9]{2}[-_/]?[0-9]{2}[tT_-][0-9]{2,6}[zZ]?(?:[+-][0-9]{2,4})?")
_LETTERS = re.compile(r"[A-Za-z]{%d,}" % RUN)
_PIECES = r"""[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def random_spans(text: str, encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Strings of fewer than `ratio` characters a token (`SHORT_RATIO` if short) that are no digests, dates or numbers."""
    found = []
    for m in _CANDIDATE.finditer(text):
        value = m[0]
        if _DIGEST.fullmatch(value) or _UUID.fullmatch(value) or _STAMP.fullmatch(value):
            continue
        parts = _LETTERS.findall(value) if _IDENTIFIER.fullmatch(value) else [value]
        n = sum(map(len, parts))
        if n < SHORTEST:  # an identifier of short runs and numbers
            continue
        tokens = sum(len(encoding.encode_ordinary(x)) for x in parts)
        if n < (ratio if n >= LONG else min(ratio, SHORT_RATIO)) * tokens:
            found.append((m.start(), 3, m.end()))
    return found


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def scan(documents: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, text: str = "text") -> DataFrame:
    """`documents` without its text, with the counts of base spans, their digest, and all spans."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:  # read once here: executors need no copy of the file
        shared = spark.sparkContext.broadcast(f.read())
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    kept = [c for c in documents.columns if c != text and c not in made]
    schema = documents.select(*kept).schema
    for name in made[:3]:
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    rows = documents.select(*kept, text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("scan", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for value in batch.column(len(kept)).to_pylist():
                value = value or ""
                base = base_spans(value)
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + random_spans(value, encoding, ratio)))
            columns = [*batch.columns[: len(kept)], *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(found, schema)
