"""BAM as a Spark data source: `spark.read.format("alignments").load(paths)`.

A BAM is a series of BGZF blocks, each compressed alone, so a file is cut into splits by bytes: a split begins at the
first block whose header is found at or after its start. Where its first record begins is found by checking that a chain
of whole records parses, over as many blocks as that takes; where no chain tells, the records are counted off from the
file's beginning. Records that run over the end of a split are finished from the next blocks. Paths are read through
Python's file system, so they must be mounted on every executor.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, chrm string, pos int, rpos int, qual int, flag int, cigar array<struct<op:string,len:int>>, mchrm string, mpos int, isize int, qname string, "
    "xs string, ts string, nh int, hi int, nm int"
)
OPS = "MIDNSHP=X"
SPLIT = 64 << 20
BATCH = 20_000
LARGEST = 1 << 16
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def block_size(head: bytes) -> int | None:
    """The length of the BGZF block that begins with `head`, or None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        tag, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the blocks from offset `at` on."""
    while True:
        f.seek(at)
        head = f.read(LARGEST + 1024)
        size = block_size(head)
        if size is None:
            if head:
                raise ValueError(f"no BGZF block at {at}")
            return
        extra = struct.unpack_from("<H", head, 10)[0]
        yield at, zlib.decompress(head[12 + extra : size - 8], -15)
        at += size


def first_block(f, at: int, end: int) -> int | None:
    """The first offset in [at, end) where a block begins that another block, or the end, follows."""
    f.seek(at)
    data = f.read(min(end - at, LARGEST) + 2 * LARGEST)
    k = data.find(b"\x1f\x8b\x08\x04")
    while 0 <= k < end - at:
        size = block_size(data[k : k + 1024])
        if size is not None and (k + size == len(data) or block_size(data[k + size : k + size + 1024]) is not None):
            return at + k
        k = data.find(b"\x1f\x8b\x08\x04", k + 1)
    return None


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Reference names and lengths; the block and the place in it where records begin."""
    with open(path, "rb") as f:
        data, starts = b"", []
        for at, part in blocks(f, 0):
            starts.append((len(data), at))
            data += part
            try:
                if data[:4] != b"BAM\1":
                    raise ValueError(f"not a BAM file: {path}")
                k = 8 + struct.unpack_from("<i", data, 4)[0]
                n, k = struct.unpack_from("<i", data, k)[0], k + 4
                refs = []
                for _ in range(n):
                    size = struct.unpack_from("<i", data, k)[0]
                    refs.append((data[k + 4 : k + 3 + size].decode(), struct.unpack_from("<i", data, k + 4 + size)[0]))
                    k += 8 + size
            except struct.error:
                continue
            if k > len(data):
                continue
            base, block = [x for x in starts if x[0] <= k][-1]
            return refs, block, k - base
    return [], 0, 0


def _plausible(data: bytes, k: int, refs: int, ended: bool, depth: int = 3) -> bool | None:
    """Whether `depth` whole records, or all up to the file's end, begin at k; None if `data` does not reach that far."""
    for n in range(depth):
        if k + 36 > len(data):
            return (n > 0 and k == len(data)) if ended else None
        size, ref, pos, name, _, _, cigar, _, seq, mref, mpos = struct.unpack_from("<iiiBBHHHiii", data, k)
        if size < 32 or name < 1 or seq < 0 or not -1 <= ref < refs or not -1 <= mref < refs or pos < -1 or mpos < -1 or size < 32 + name + 4 * cigar + (seq + 1) // 2 + seq:
            return False
        if k + 36 + name <= len(data) and data[k + 35 + name] != 0:
            return False
        k += 4 + size
    return True if k <= len(data) else False if ended else None


def first_record(f, at: int, end: int, refs: int) -> int | None:
    """Where the first record that begins in the blocks from `at` to before `end` begins in their contents.

    None if none does: a later one is the first, or none is left. Raises LookupError if no chain of records tells.
    """
    data, own, seen, unsure = bytearray(), None, 0, []
    for offset, part in itertools.chain(blocks(f, at), [(None, b"")]):
        if own is None and (offset is None or offset >= end):
            own = len(data)
        data += part
        left = []
        for x in itertools.chain(unsure, range(seen, len(data))):
            found = _plausible(data, x, refs, offset is None)
            if found:
                return x if own is None or x < own else None
            if found is None:
                left.append(x)
        unsure, seen = left, len(data)
    raise LookupError("no chain of records")


def counted_record(path: str, at: int, end: int) -> int | None:
    """As `first_record`, counted off from the file's first record."""
    _, block, k = header(path)
    with open(path, "rb") as f:
        data, base, own = b"", None, None  # base, own: where the contents of the blocks from `at` and from `end` on begin in data
        for offset, part in itertools.chain(blocks(f, block), [(None, b"")]):
            if base is None and offset is not None and offset >= at:
                base = len(data)
            if own is None and (offset is None or offset >= end):
                own = len(data)
            data += part
            while k + 4 <= len(data) and (base is None or k < base):
                k += 4 + struct.unpack_from("<i", data, k)[0]
            if base is not None and (k >= base and (own is not None or k < len(data))):
                return k - base if own is None or k < own else None
            gone = min(k, len(data)) if base is None else 0
            data, k = data[gone:], k - gone
    if base is None or k > len(data):
        raise ValueError(f"{path} ends within a record")
    return None


def _tags(data: bytes, k: int, end: int) -> dict:
    found = {}
    while k + 3 <= end:
        tag, kind = data[k : k + 2].decode("ascii", "replace"), chr(data[k + 2])
        k += 3
        if kind == "Z" or kind == "H":
            stop = data.index(b"\0", k, end)
            found[tag] = data[k:stop].decode("utf-8", "replace")
            k = stop + 1
        elif kind == "B":
            k += 5 + _SIZES[chr(data[k])] * struct.unpack_from("<i", data, k + 1)[0]
        else:
            found[tag] = chr(data[k]) if kind == "A" else struct.unpack_from(_FORMATS[kind], data, k)[0] if kind in _FORMATS else None
            k += _SIZES[kind]
    return found


def parse(data: bytes, k: int, size: int, refs: list[tuple[str, int]], path: str) -> dict:
    ref, pos, name, qual, _, n_cigar, flag, seq, mref, mpos, isize = struct.unpack_from("<iiBBHHHiiii", data, k)
    at = k + 32 + name
    cigar = [{"op": OPS[x & 15], "len": x >> 4} for x in struct.unpack_from(f"<{n_cigar}I", data, at)]
    tags = _tags(data, at + 4 * n_cigar + (seq + 1) // 2 + seq, k + size)
    named = lambda r: refs[r][0] if 0 <= r < len(refs) else None
    return {
        "path": path, "chrm": named(ref), "pos": pos, "rpos": pos + sum(x["len"] for x in cigar if x["op"] in "MDN=X"), "qual": qual, "flag": flag, "cigar": cigar,
        "mchrm": named(mref), "mpos": mpos, "isize": isize, "qname": data[k + 32 : k + 31 + name].decode("ascii", "replace"),
        "xs": tags.get("XS") if tags.get("XS") in ("+", "-") else None, "ts": tags.get("ts"), "nh": tags.get("NH"), "hi": tags.get("HI"), "nm": tags.get("nM", tags.get("NM")),
    }


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def records(split: Split) -> Iterator[dict]:
    """The records whose first byte lies in a block of the split."""
    refs, block, inner = header(split.path)
    with open(split.path, "rb") as f:
        if split.start <= block < split.end:
            at, k = block, inner
        else:
            at = first_block(f, max(split.start, block), split.end)
            if at is None:
                return
            try:
                k = first_record(f, at, split.end, len(refs))
            except LookupError:
                k = counted_record(split.path, at, split.end)
            if k is None:
                return
        data, own = b"", None  # own: bytes of data from blocks of the split
        for offset, part in blocks(f, at):
            if offset >= split.end and own is None:
                own = len(data)
            data += part
            if k >= len(data) and own is None:
                continue
            while k + 4 <= len(data) and (own is None or k < own):
                size = struct.unpack_from("<i", data, k)[0]
                if k + 4 + size > len(data):
                    break
                yield parse(data, k + 4, size, refs, split.path)
                k += 4 + size
            if own is not None and k >= own:
                return
            data, k, own = data[k:], 0, None if own is None else own - k


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Split]:
        return [Split(p, a, min(a + self.split, size)) for p in self.paths for size in [os.path.getsize(p)] for a in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = _arrow_schema()
        held = []
        for row in records(partition):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow_schema() -> pa.Schema:
    op = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
    text, whole = pa.string(), pa.int32()
    kinds = (text, text, whole, whole, whole, whole, op, text, whole, whole, text, text, text, whole, whole, whole)
    names = ("path", "chrm", "pos", "rpos", "qual", "flag", "cigar", "mchrm", "mpos", "isize", "qname", "xs", "ts", "nh", "hi", "nm")
    return pa.schema(list(zip(names, kinds, strict=True)))


class Alignments(DataSource):
    """Options: `path` (a file, a folder or a pattern) or `paths` (a JSON list of files), and `split` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "paths" in self.options:
            return _Reader(json.loads(self.options["paths"]), int(self.options.get("split", SPLIT)))
        path = self.options["path"]
        path = os.path.join(path, "*.bam") if os.path.isdir(path) else path
        return _Reader(sorted(glob.glob(path)), int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Alignments)


def chromosomes(spark: SparkSession, manifest) -> object:
    """(sample_id, tid, chrm, len): every sample's reference dictionary, read where its file is read."""
    def read(batches):
        for batch in batches:
            rows = []
            for sample, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"sample_id": sample, "tid": k, "chrm": name, "len": size} for k, (name, size) in enumerate(header(path)[0])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sample_id", pa.int32()), ("tid", pa.int32()), ("chrm", pa.string()), ("len", pa.int32())]))

    return manifest.select("sample_id", "align_file").mapInArrow(read, "sample_id int, tid int, chrm string, len int")
