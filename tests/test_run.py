"""From BAM files to GTF files, and the sink that leaves whole files only."""

import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom import run
from strandloom.config import Parameters
from strandloom.sources import bam, files
from strandloom.sources.sample_files import folder, write_files
from tests.test_sources import bgzf


def write_bam(path, rows):
    """`rows`: (name, pos, operations, flag, strand tag)."""
    data = b"BAM\1" + struct.pack("<iii", 0, 1, 5) + b"chr1\0" + struct.pack("<i", 99_999)
    for name, pos, ops, flag, xs in rows:
        name = name.encode() + b"\0"
        cigar = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(op)) for op, n in ops)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 60, 0, len(ops), flag, 10, 0, pos, 100) + name + cigar + b"\x11" * 5 + b"\x28" * 10 + b"NHC\x01" + (b"XSA" + xs.encode() if xs else b"")
        data += struct.pack("<i", len(body)) + body
    path.write_bytes(bgzf(data) + bgzf(b""))


def test_manifest_to_files(spark, tmp_path):
    both = [("M", 300), ("N", 200), ("M", 300), ("N", 400), ("M", 300)]
    skip = [("M", 300), ("N", 900), ("M", 300)]
    write_bam(tmp_path / "a.bam", [(f"a{k}", 100, both, 0, "+") for k in range(8)] + [(f"x{k}", 100, skip, 0, "+") for k in range(5)])
    # sample b has pairs: both mates share a name, and only together they span the second intron's exons
    left, right = [("M", 250), ("N", 200), ("M", 280)], [("M", 290), ("N", 400), ("M", 290)]
    write_bam(tmp_path / "b.bam", [r for k in range(6) for r in ((f"p{k}", 150, left, 0x1 | 0x20 | 0x40, "+"), (f"p{k}", 610, right, 0x1 | 0x10 | 0x80, "+"))])
    write_bam(tmp_path / "c.bam", [])
    (tmp_path / "list").write_text("".join(f"{tmp_path}/{x}.bam - paired_end\n" for x in "abc"))
    out = str(tmp_path / "out")
    merged = run.assemble_manifest(spark, str(tmp_path / "list"), out, Parameters(insertsize_high=1200), width=512)
    assert sorted(os.listdir(out)) == ["0.gtf", "1.gtf", "2.gtf", "3.gtf", "merged.gtf"]
    whole, short = (400, 600, 900, 1300), (400, 1300)
    rows = {tuple(r.chain): r for r in merged.collect()}
    assert whole in rows and short in rows and set(rows[whole].samples) >= {0, 1} and 1 not in rows[short].samples
    chains = {}
    for name in ("0", "1", "2", "merged"):
        items = files.transcripts_of(files.read_gtf(spark, f"{out}/{name}.gtf")).collect()
        chains[name] = {tuple(x for a, b in zip(r.exons, r.exons[1:]) for x in (a["end"], b["start"])) for r in items}
        assert {r.strand for r in items} <= {"+"}
    assert chains["0"] == {whole, short} == chains["merged"] and chains["1"] == {whole} and chains["2"] == set()


def test_one_file_a_name_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = spark.range(300).select((F.col("id") % 3).alias("name"), F.concat(F.lit("line é "), "id").alias("value"), "id")
    write_files(lines, out, ".txt", ["id"], spark.createDataFrame([(7,), (1,)], "name int"))
    assert sorted(os.listdir(out)) == ["0.txt", "1.txt", "2.txt", "7.txt"] and os.path.getsize(f"{out}/7.txt") == 0
    assert open(f"{out}/1.txt", encoding="utf-8").read().splitlines() == [f"line é {k}" for k in range(1, 300, 3)]
    broken = lines.withColumn("value", F.when(F.col("id") == 250, F.raise_error(F.lit("stop"))).otherwise(F.upper("value")))
    with pytest.raises(PySparkException):
        write_files(broken, out, ".txt", ["id"])
    assert sorted(os.listdir(out)) == ["0.txt", "1.txt", "2.txt", "7.txt"] and "line" in open(f"{out}/0.txt", encoding="utf-8").read()
    write_files(lines.where("name = 2").withColumn("value", F.lit("new")), f"file://{out}", ".txt", ["id"])
    assert open(f"{out}/2.txt").read() == "new\n" * 100
    with pytest.raises(ValueError):
        folder("hdfs://store/out")
    with pytest.raises(SystemExit):
        run.main(["list", "out", "--nonsense", "1"])
