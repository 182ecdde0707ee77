import gzip
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions.fields import any_pattern, first_value, indexed_value, jvm_pattern, u32
from strandline.plans import commands as c
from strandline.plans.model import build_index
from strandline.sources import bam as bam_source
from strandline.sources.annotation import SeveralFiles, read_lines, save_lines, save_table, write_lines
from strandline.sources.regions import BadRegion, bed_lenient, bed_strict, parse_region, read_list, read_regions, sam
from strandline.streaming.depth import replayed_depth
from tests.test_demo import BED, TEXT


def test_offsets_over_many_splits(spark, tmp_path):
    text = "".join(f"chr1\tü{'x' * (i % 97)}\n" for i in range(3000)) + "open end\r"
    (tmp_path / "a.gff").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = read_lines(spark, str(tmp_path / "a.gff")).orderBy("off").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.part for r in rows}) > 5 and [r.part for r in rows] == sorted(r.part for r in rows)
    at = 0
    for r, line in zip(rows, text.encode().split(b"\n"), strict=True):
        assert r.off == at and r.line.encode() == line
        at += len(line) + 1
    assert [r.eol for r in rows[-2:]] == ["\n", ""]


def test_blocks_over_many_splits(spark, tmp_path):
    lines = ["#head"] + [f"chr{i % 3}\ts\t{'gene' if i % 40 == 0 else 'exon'}\t{i + 1}\t{i + 9}\t.\t+\t.\tID=f{i}" + (f";Parent=f{i - i % 40}" if i % 40 else "") for i in range(2000)]
    (tmp_path / "a.gff").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = build_index(spark, str(tmp_path / "a.gff"), save=f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = found.lines.orderBy("off").collect()
    starts = [r.off for r in rows if r.type == "gene"]
    assert rows[0].b0 is None and all(r.b0 == max(s for s in starts if s <= r.off) for r in rows[1:])
    ends = {b.b0: b.b1 for b in found.blocks.collect()}
    assert ends == dict(zip(starts, [*starts[1:], os.path.getsize(tmp_path / "a.gff")]))


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_bytes_survive(spark, tmp_path, end):
    data = TEXT.replace("\n", end).rstrip("\r\n").encode()
    (tmp_path / "a.gff").write_bytes(data)
    found = build_index(spark, str(tmp_path / "a.gff"))
    write_lines(c.sample(found, 1.0), str(tmp_path / "out.gff"))
    assert (tmp_path / "out.gff").read_bytes() == data[data.index(b"chr1") :]
    save_lines(c.sample(found, 1.0), f"{tmp_path}/parts")
    parts = sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("part-"))
    assert b"".join((tmp_path / "parts" / p).read_bytes() for p in parts).rstrip(b"\n") == data[data.index(b"chr1") :]


def test_empty_files(spark, tmp_path):
    for text in ("", "##gff-version 3\n", "\n\n"):
        (tmp_path / "e.gff").write_text(text)
        found = build_index(spark, str(tmp_path / "e.gff"))
        regions = spark.createDataFrame([(1, "chr1", 0, 10)], "rid long, seqid string, qs long, qe long")
        assert c.intersect(found, regions).count() == c.depth(found, regions).count() == c.coverage(found, regions).count() == c.sample(found, 0.5).count() == 0


def test_numbers_and_values(spark):
    rows = ["0", "007", "4294967295", "4294967296", "99999999999999999999", "+5", "-1", " 5", "", "1.5", "٣", "5\n"]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select("t", u32(F.col("t")).alias("a"), u32(F.col("t"), True).alias("b"))
    got = {r.t: (r.a, r.b) for r in df.collect()}
    assert got["0"] == (0, 0) and got["007"] == (7, 7) and got["4294967295"] == (4294967295,) * 2 and got["+5"] == (None, 5)
    assert all(got[x] == (None, None) for x in rows[3:5] + rows[6:])
    df = spark.createDataFrame([("geneID=g;ID=a b;x=ID=z",), ("ID=;Name=q",), ("none",)], "t string")
    assert [r[0] for r in df.select(first_value(F.col("t"), "ID", "; \\t")).collect()] == ["g", "", None]
    assert [r[0] for r in df.select(indexed_value(F.col("t"), "ID", r";\s")).collect()] == ["g", None, None]
    assert [r[0] for r in spark.range(1).select(first_value(F.lit("a.b+c=1;axb+c=2"), "a.b+c", ";")).collect()] == ["1"]
    assert jvm_pattern("(?P<n>x)") == "(?<n>x)"


def test_beds(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\n#c\n\nchr1\t5\t5\textra\nchr1 7\t3\nchr1\t \t1\t9 \r\nchrX\tbad\t1\nchr1\t1\nchr1\t+2\t4294967295\n")
    known = spark.createDataFrame([("chr1",)], "seqid string")
    strict = sorted((r.qs, r.qe) for r in bed_strict(spark, str(tmp_path / "a.bed"), known).collect())
    assert strict == [(1, 9), (2, 4294967295), (5, 5), (7, 3)]
    lenient = {(r.seqid, r.qs, r.qe) for r in bed_lenient(spark, str(tmp_path / "a.bed")).collect()}
    assert ("chr1", 2, 4294967295) in lenient and not any(a >= b for _, a, b in lenient)
    (tmp_path / "b.bed").write_text("chr1\tx\t9\n")
    with pytest.raises(Exception, match="bad number"):
        bed_strict(spark, str(tmp_path / "b.bed"), known).collect()
    assert bed_lenient(spark, str(tmp_path / "b.bed")).count() == 0


def test_literals_and_lists(spark, tmp_path):
    assert parse_region("chr1:2-30") == ("chr1", 2, 30)
    for bad in ("chr1", "chr1:5", "chr1:5-5", "chr1:9-5", "chr1:a-5", "chr1:-1-5", "chr1:1-4294967296", "chr1:1-2-3"):
        with pytest.raises(BadRegion):
            parse_region(bad)
    (tmp_path / "l.txt").write_bytes(" a \r\n\nb\nb\n\t\nc d".encode())
    assert sorted(r.value for r in read_list(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b", "c d"]
    with pytest.raises(NotImplementedError):
        read_regions(spark, "x.CRAM")
    with pytest.raises(BadRegion):
        read_regions(spark, "x.txt")


ALIGNED = [  # flag, name, 1-based position, cigar, and what it spans
    (0, "chr1", 1501, "10M", (1500, 1510)),
    (4, "chr1", 1501, "10M", None),
    (0, "*", 0, "*", None),
    (256 | 1024, "chr1", 101, "5S10M100N10M2D3I5=1X9H", (100, 228)),
    (16, "chr2", 2001, "*", (2000, 2001)),
    (0, "chr2", 0, "5M", None),
    (0, "chrU", 5, "5M", (4, 9)),
]


def packed_bam(block=60):
    names = ["chr1", "chr2", "chrU"]
    out = b"BAM\1" + struct.pack("<i", 5) + b"@HD\tx"[:5] + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**6)
    import re

    for flag, name, pos, cigar, _ in ALIGNED:
        ops = [(int(n) << 4) | "MIDNSHP=X".index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        body = struct.pack("<iiBBHHHiiii", names.index(name) if name in names else -1, pos - 1, 2, 9, 0, len(ops), flag, 0, -1, -1, 0) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops)
        out += struct.pack("<i", len(body)) + body

    def member(data):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))

    return b"".join(member(out[i : i + block]) for i in range(0, len(out), block)) + member(b"")


def test_alignments(spark, tmp_path):
    want = sorted((n, *s) for _, n, _, _, s in ALIGNED if s)
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n@SQ\tSN:chr1\tLN:9\n" + "".join(f"r\t{f}\t{n}\t{p}\t9\t{g}\t*\t0\t0\t*\t*\n" for f, n, p, g, _ in ALIGNED))
    assert sorted((r.seqid, r.qs, r.qe) for r in sam(spark, str(tmp_path / "a.sam")).collect()) == want
    (tmp_path / "a.bam").write_bytes(packed_bam())
    assert sorted((r.seqid, r.qs, r.qe) for r in read_regions(spark, str(tmp_path / "a.bam")).collect()) == want
    whole = packed_bam(10**6)
    for bad in (gzip.compress(b"not bam"), whole[:-40], b"plain"):
        with pytest.raises(bam_source.BadBam):
            import io

            list(bam_source.records(io.BytesIO(bad)))
    (tmp_path / "d.gff").write_text(TEXT)
    found = build_index(spark, str(tmp_path / "d.gff"))
    assert {r.id: r.depth for r in c.depth(found, read_regions(spark, str(tmp_path / "a.bam"))).collect()}["c1"] == 1


def test_command_line(spark, tmp_path, capsys):
    gff, bed, out = f"{tmp_path}/d.gff", f"{tmp_path}/d.bed", f"{tmp_path}/out"
    (tmp_path / "d.gff").write_text(TEXT)
    (tmp_path / "d.bed").write_text(BED)
    (tmp_path / "ids").write_text("t1\nnope\n")
    assert cli.main(["extract", "-i", gff, "-f", "t1"]) == 1 and "index" in capsys.readouterr().err
    assert cli.main(["index", "-i", gff]) == 0

    def lines(*args):
        assert cli.main([args[0], "-i", gff, "-o", out, *args[1:]]) == 0
        return [TEXT.split("\n").index(x) + 1 for x in open(out).read().split("\n")[:-1]]

    assert lines("intersect", "-b", bed, "-C", "-I") == [15, 16] and lines("intersect", "-r", "chr1:999-1000") == [3, 4, 5]
    assert lines("intersect", "-b", bed, "-e", "-T", "exon") == [5, 6, 11, 14, 15, 16]
    with pytest.warns(UserWarning):
        assert lines("extract", "-F", f"{tmp_path}/ids") == [4]
    assert lines("search", "-a", "ALPHA", "-r") == [3, 4, 13]
    assert lines("sample", "-r", "1") == list(range(3, 18))
    for args in (["search", "-a", "ZERO"], ["intersect", "-r", "chrX:1-2"], ["intersect", "-r", "chr1:2-1"], ["depth", "-s", "x.cram"]):
        assert cli.main([args[0], "-i", gff, *args[1:]]) == 1
    assert cli.main(["depth", "-i", gff, "-s", bed, "-o", out]) == 0 and open(out).read().startswith("id\tchr\tstart\tend\tdepth\nc1\tchr1\t1499\t5499\t1\n")
    assert cli.main(["coverage", "-i", gff, "-s", bed, "-o", out]) == 0 and "e5\tchr2\t2599\t3000\t61\t0.152120\n" in open(out).read()
    with pytest.raises(SystemExit):
        cli.main(["intersect", "-i", gff])


def test_table_folders(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", 1 / 3)], "id string, fraction double")
    save_table(df, f"{tmp_path}/t", "fraction")
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t")
    assert sorted(map(tuple, got.collect())) == [("a", "0.333333"), ("b", "0.500000")]


def test_output_folders(spark, tmp_path):
    (tmp_path / "d.gff").write_text(TEXT)
    (tmp_path / "d.bed").write_text(BED)
    gff, bed = f"{tmp_path}/d.gff", f"{tmp_path}/d.bed"
    assert cli.main(["index", "-i", gff]) == 0
    assert cli.main(["intersect", "-i", gff, "-b", bed, "-e", "-o", f"{tmp_path}/lines", "-P"]) == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == sorted(TEXT.split("\n")[2:17])
    assert cli.main(["depth", "-i", gff, "-s", bed, "-o", f"{tmp_path}/depth", "--parts"]) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/depth").filter("id = 'c1'").first().depth == "1"
    with pytest.raises(SystemExit):
        cli.main(["depth", "-i", gff, "-s", bed, "-P"])


def test_several_files_are_an_error(spark, tmp_path):
    for name in "ab":
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.gff").write_text(TEXT)
    with pytest.raises(SeveralFiles):
        build_index(spark, f"{tmp_path}/in")
    assert cli.main(["index", "-i", f"{tmp_path}/in"]) == 1


def test_bytes_that_are_not_utf8(spark, tmp_path):
    """They come out as they went in; a block with such a line has neither depth nor coverage."""
    raw = TEXT.encode().replace(b"###\n", b"# caf\xe9 \xff\n", 1)
    (tmp_path / "r.gff").write_bytes(raw)
    found = build_index(spark, f"{tmp_path}/r.gff")
    regions = spark.createDataFrame([(1, "chr1", 1500, 8200), (2, "chr2", 2000, 2650)], "rid long, seqid string, qs long, qe long")
    write_lines(c.intersect(found, regions, entire=True), f"{tmp_path}/out")
    assert b"# caf\xe9 \xff\n" in open(f"{tmp_path}/out", "rb").read()
    for table in (c.depth(found, regions), c.coverage(found, regions)):
        ids = {r.id for r in table.collect()}
        assert "g1" not in ids and {"g2", "g3"} <= ids


def test_patterns_are_those_of_unicode(spark):
    def match(pattern, value):
        return spark.createDataFrame([(value,)], "v string").filter(F.col("v").rlike(any_pattern([pattern]))).count() == 1

    assert match(r"^\w\d$", "é1") and match(r"^\w\d$", "é٣") and match(r"^a\s$", "a\u2003") and not match(r"^a$", "a\r")
    assert match("^a.b$", "a\rb") and match("^a.b$", "a\u2028b") and not match("^a.b$", "a\nb") and match("(?i)^STRASSE|É$", "é") and match("(?P<x>a)b", "ab")


def test_warnings(spark, tmp_path):
    rows = ["ID=a;Parent=b;gene_name=LOOP", "ID=b;Parent=a;gene_name=LOOP", "ID=r;gene_name=LOOP", "ID=s;gene_name=two words"]
    (tmp_path / "w.gff").write_text("".join(f"chr1\ts\tgene\t{i + 1}\t9\t.\t+\t.\t{x}\n" for i, x in enumerate(rows)))
    with pytest.warns(UserWarning, match="blanks or commas"):
        found = build_index(spark, f"{tmp_path}/w.gff")
    with pytest.warns(UserWarning, match="2 of the features found have no root"):
        assert c.search(found, values=["LOOP"], warn=True).count() == 1


def test_depth_of_a_stream_names_the_first_lines_sequence(spark, tmp_path):
    """An id on two sequences, the later in the alphabet first: the stream says what the batch says."""
    rows = ["chr2\ts\tgene\t101\t200\t.\t+\t.\tID=x", "chr1\ts\tgene\t101\t200\t.\t+\t.\tID=x", "chr1\ts\tgene\t301\t400\t.\t+\t.\tID=y", "chr1\ts\texon\t301\t350\t.\t+\t.\tID=z;Parent=x"]
    (tmp_path / "s.gff").write_text("\n".join(rows) + "\n")
    found = build_index(spark, f"{tmp_path}/s.gff", save=f"{tmp_path}/s.index")
    regions = spark.createDataFrame([(i, f"chr{1 + i % 2}", 90 + 10 * i, 150 + 12 * i) for i in range(30)], "rid long, seqid string, qs long, qe long")
    batch = sorted(map(tuple, c.depth(found, regions).collect()))
    assert batch and batch == sorted(map(tuple, replayed_depth(found, regions, files=4).collect()))
