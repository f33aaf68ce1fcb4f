import random
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.sources import bam, files
from strandloom.streaming import bundles


def bgzf(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(k, ref, pos, ops, flag):
    name = f"read{k}".encode() + b"\0"
    cigar = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(op)) for op, n in ops)
    tags = b"NHC\x01" + b"XSA+" + b"MDZ10A5\0" + b"nMi" + struct.pack("<i", k)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(ops), flag, 10, ref, pos + 100, 110) + name + cigar + b"\x11" * 5 + b"\x28" * 10 + tags
    return struct.pack("<i", len(body)) + body


@pytest.fixture(scope="module")
def bam_file(tmp_path_factory):
    rng = random.Random(1)
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 9999) for n in (b"chr1", b"chr2"))
    data = head + b"".join(record(k, k % 2, 10 * k, [("M", 5), ("N", 7 + k % 3), ("M", 5)], 0x1) for k in range(3000))
    path = tmp_path_factory.mktemp("bam") / "one.bam"
    out, at = b"", 0
    while at < len(data):
        n = rng.randrange(500, 9000)
        out += bgzf(data[at : at + n])
        at += n
    path.write_bytes(out + bgzf(b""))
    return str(path)


@pytest.mark.parametrize("split", [1 << 20, 5000])
def test_bam_reads_every_record_once(spark, bam_file, split):
    bam.register(spark)
    df = spark.read.format("alignments").option("split", split).load(bam_file)
    assert df.rdd.getNumPartitions() > 1 or split > 10_000
    got = sorted(df.select("nm", "qname", "chrm", "pos", "rpos", "nh", "xs", "mpos").collect())
    assert [tuple(r) for r in got] == [(k, f"read{k}", f"chr{k % 2 + 1}", 10 * k, 10 * k + 17 + k % 3, 1, "+", 10 * k + 100) for k in range(3000)]
    manifest = spark.createDataFrame([(0, bam_file)], "sample_id int, align_file string")
    assert [tuple(r) for r in bam.chromosomes(spark, manifest).collect()] == [(0, 0, "chr1", 9999), (0, 1, "chr2", 9999)]


@pytest.mark.parametrize("longest_last", [False, True])
def test_bam_records_longer_than_blocks_and_splits_are_read_once(tmp_path, longest_last):
    rng = random.Random(2)
    data = b"BAM\1" + struct.pack("<iii", 0, 1, 5) + b"chr1\0" + struct.pack("<i", 9999)
    for k in range(60):
        seq = rng.choice([20, 3000, 40_000]) if k < 59 or not longest_last else 90_000
        name, bases = f"read{k}".encode() + b"\0", rng.choice([rng.randbytes((seq + 1) // 2), bytes((seq + 1) // 2)])
        body = struct.pack("<iiBBHHHiiii", 0, k, len(name), 60, 0, 1, 0, seq, 0, k, 1) + name + struct.pack("<I", seq << 4) + bases + rng.randbytes(seq) + b"nMi" + struct.pack("<i", k)
        data += struct.pack("<i", len(body)) + body
    path = tmp_path / "long.bam"
    path.write_bytes(b"".join(bgzf(data[x : x + 9000]) for x in range(0, len(data), 9000)) + bgzf(b""))
    size = path.stat().st_size
    for step in (7000, 20_000, size):
        got = [r["nm"] for a in range(0, size, step) for r in bam.records(bam.Split(str(path), a, min(a + step, size)))]
        assert got == list(range(60))


def test_manifest(spark, tmp_path):
    path = tmp_path / "list"
    path.write_text("a.bam a.bai paired_end\n\nb.bam  b.bai\tont\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(path)).select("sample_id", "align_file", "data_type").collect()] == [(0, "a.bam", 1), (1, "b.bam", 5)]
    path.write_text("a.bam a.bai nonsense\n")
    with pytest.raises(PySparkException):
        files.read_manifest(spark, str(path)).collect()


def test_profiles_round_trip(spark, tmp_path):
    (tmp_path / "0.profile").write_text("library_type 2\nbam_with_xs 1\ninsertsize_ave 250.5\n")
    (tmp_path / "1.profile").write_text("library_type 1\nbam_with_xs 0\n")
    df = files.read_profiles(spark, str(tmp_path)).orderBy("sample_id")
    assert [tuple(r) for r in df.select("sample_id", "library_type", "bam_with_xs", "insertsize_ave").collect()] == [(0, 2, 1, 250.5), (1, 1, 0, None)]
    files.write_by_sample(files.profile_lines(df), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_gtf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", "+", "g1", "t1", 1.5, [(10, 20), (30, 45)], 2), ("chr1", "-", "g2", "t2", 2.25, [(5, 9)], 1)], "seqname string, strand string, gene_id string, transcript_id string, cov double, exons array<struct<start:int,end:int>>, count int")
    files.write_gtf(df, str(tmp_path / "gtf"))
    items = files.read_gtf(spark, str(tmp_path / "gtf"))
    assert items.where("feature = 'transcript'").agg(F.sum("count")).first()[0] == 3
    got = [tuple(r) for r in files.transcripts_of(items).orderBy("transcript_id").collect()]
    assert got == [("chr1", "+", "g1", "t1", 1.5, [(10, 20), (30, 45)]), ("chr1", "-", "g2", "t2", 2.25, [(5, 9)])]


def test_features_round_trip(spark, tmp_path):
    row = [f"x{k}" if c in files.TEXT_FEATURES else k for k, c in enumerate(files.FEATURES)]
    df = spark.createDataFrame([row], ", ".join(f"`{c}` {'string' if c in files.TEXT_FEATURES else 'int'}" for c in files.FEATURES))
    kinds = dict(x.replace("`", "").split() for x in files.feature_schema().split(", "))
    typed = df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in files.FEATURES))
    files.write_features(typed, str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).collect() == typed.collect() and len(files.FEATURES) == 51


def test_streams_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:20", 2.0), (1, "2024-01-01 00:02:00", 4.0), (2, "2024-01-01 00:00:05", 8.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("s", bundles.session_bundles(stream, ["user_id"], "ts", 30)), ("w", bundles.windowed_counts(stream, ["user_id"], "ts", "1 minute"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("s").select("user_id", "n").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted(tuple(r) for r in spark.table("w").select("user_id", "n", "total").collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]
