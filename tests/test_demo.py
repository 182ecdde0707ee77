"""The worked example: a small file with every odd case, and what each command gives for it."""

import pytest

from strandline.plans import commands as c
from strandline.plans.model import Annotation, BadAnnotation, build_index, missing_tables
from strandline.sources.annotation import write_lines, write_table
from strandline.sources.regions import bed_lenient, bed_strict, literal_region

ROWS = """##gff-version 3
#!demo
chr1 src gene 1000 9000 . + . ID=g1;gene_name=ALPHA
chr1 src mRNA 1000 9000 . + . ID=t1;Parent=g1;gene_name=ALPHA
chr1 src exon 1000 1999 . + . ID=e1;Parent=t1
chr1 src exon 5000 5999 . + . ID=e2;Parent=t1
chr1 src CDS 1500 1999 . + 0 ID=c1;Parent=t1
chr1 src CDS 5000 5499 . + 0 ID=c1;Parent=t1
###
chr1 src gene 8500 8000 . - . ID=g2;gene_name=BETA
chr1 src exon 8000 8500 . - . ID=e3;Parent=g2
chr2 src region 1 50000 . . . ID=chr2reg;note=skipped
chr2 src gene 2000 3000 . + . ID=g3;gene_name=ALPHA2
chr2 src exon 2000 2500 . + . ID=e4;Parent=g3
chr2 src exon 2600 3000 . + . ID=e5;Parent=g3,gX
chr2 src exon 2900 3000 . + . ID=e6;Parent=g3
chr2 src gene 7 0 . + . ID=g0;gene_name=ZERO
"""
TEXT = "\n".join(x if x.startswith("#") else x.replace(" ", "\t") for x in ROWS.split("\n"))
OFFSETS = [0, 16, 23, 75, 137, 183, 229, 274, 319, 323, 374, 420, 474, 527, 573, 622, 668]
NUMBER = {off: i + 1 for i, off in enumerate(OFFSETS)}
BED = "chr1\t1500\t5200\nchr1\t8100\t8200\nchr2\t2000\t2650\nchr2\t2950\t2960\nchrX\t1\t10\n"


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("demo")
    (d / "demo.gff").write_bytes(TEXT.encode())
    (d / "demo.bed").write_text(BED)
    assert len(TEXT.encode()) == 713
    return d, build_index(spark, str(d / "demo.gff"), save=f"file://{d}/index")


def numbers(df):
    return sorted(NUMBER[r.off] for r in df.collect())


def span(text):
    out = []
    for part in filter(None, text.split(",")):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def test_index(demo):
    _, found = demo
    rows = sorted(found.links.collect(), key=lambda r: r.off)
    order = {r.off: i for i, r in enumerate(rows)}
    assert [r.id for r in rows] == "g1 t1 e1 e2 c1 c1 g2 e3 g3 e4 e5 e6".split()
    assert [order[r.par] for r in rows] == [0, 0, 1, 1, 1, 1, 6, 6, 8, 8, 10, 8]
    assert [r.attr for r in rows] == ["ALPHA", "ALPHA", None, None, None, None, "BETA", None, "ALPHA2", None, None, None]
    assert sorted((order[b.fid], b.seqid, b.b0, b.b1) for b in found.blocks.collect()) == [(0, "chr1", 23, 323), (6, "chr1", 323, 474), (8, "chr2", 474, 573), (10, "chr2", 573, 713)]


@pytest.mark.parametrize(
    "mode, invert, plain, exons, entire",
    [
        ("overlap", False, "3-8,11-16", "5,6,11,14,15,16", "3-17"),
        ("overlap", True, "", "", ""),
        ("contained", False, "", "", ""),
        ("contained", True, "7,10,14", "14", "3-17"),
        ("contains", False, "3,4,11,12,13,15,16", "11,15,16", "3-17"),
        ("contains", True, "15,16", "15,16", "15-17"),
    ],
)
def test_intersect(spark, demo, mode, invert, plain, exons, entire):
    d, found = demo
    regions = bed_strict(spark, str(d / "demo.bed"), found.seqids)
    assert numbers(c.intersect(found, regions, mode, invert)) == span(plain)
    assert numbers(c.intersect(found, regions, mode, invert, types=" exon ,")) == span(exons)
    assert numbers(c.intersect(found, regions, mode, invert, entire=True, types="exon")) == span(exons)
    assert numbers(c.intersect(found, regions, mode, invert, entire=True)) == span(entire)


@pytest.mark.parametrize("region, mode, want", [("chr1:999-1000", "overlap", "3,4,5"), ("chr1:900-999", "overlap", ""), ("chr1:4999-5000", "overlap", "3,4,6,8"), ("chr1:9000-9001", "overlap", ""), ("chr1:900-9100", "contained", "3-8,10,11")])
def test_boundaries(spark, demo, region, mode, want):
    assert numbers(c.intersect(demo[1], literal_region(spark, region), mode)) == span(want)


@pytest.mark.parametrize("ids, plain, entire", [("c1", "7,8", "3-9"), ("e6", "", "13,14"), ("e5", "15", "15-17"), ("t1 nope", "4", "3-9"), ("chr2reg", "", "")])
def test_extract(spark, demo, ids, plain, entire):
    table = spark.createDataFrame([(i,) for i in ids.split()], "value string")
    assert numbers(c.extract(demo[1], table)) == span(plain)
    assert numbers(c.extract(demo[1], table, entire=True)) == span(entire)


def test_extract_types_and_misses(spark, demo):
    table = spark.createDataFrame([("t1",), ("e1",), ("nope",)], "value string")
    assert numbers(c.extract(demo[1], table, types="exon")) == [5]
    assert [r.value for r in c.missing_ids(demo[1], table).collect()] == ["nope"]
    with pytest.warns(UserWarning, match="1 of the requested"):
        c.extract(demo[1], table, warn=True)


def test_features_without_a_root(spark, tmp_path):
    row = "chr1\ts\texon\t1\t5\t.\t+\t.\tID={};Parent={}\n".format
    (tmp_path / "c.gff").write_text(TEXT + row("u", "v") + row("v", "u"))
    found = build_index(spark, str(tmp_path / "c.gff"))
    assert sorted(r.id for r in c.rootless(found).collect()) == ["u", "v"]
    table = spark.createDataFrame([("u",), ("t1",)], "value string")
    with pytest.warns(UserWarning, match="1 of the features found have no root"):
        assert [NUMBER[r.off] for r in c.extract(found, table, warn=True).collect()] == [4]


def test_search(spark, demo):
    found = demo[1]
    assert numbers(c.search(found, ["ALPHA"])) == [3, 4] and numbers(c.search(found, ["ALPHA"], entire=True)) == span("3-9")
    assert numbers(c.search(found, patterns=["ALPHA"])) == [3, 4, 13] and numbers(c.search(found, patterns=["^(?P<x>AL)"], entire=True)) == span("3-9,13,14")
    assert numbers(c.search(found, ["BETA"])) == [10] and numbers(c.search(found, ["BETA"], entire=True)) == [10, 11, 12]
    assert numbers(c.search(found, table=spark.createDataFrame([("BETA",), ("x",)], "value string"))) == [10]
    with pytest.raises(c.NothingMatched):
        c.search(found, ["ZERO"], strict=True)


COVERAGE = """g1 chr1 999 9000 3800 0.474941 999 9000 2
t1 chr1 999 9000 3800 0.474941 999 9000 2
e1 chr1 999 1999 499 0.499000 999 1999 1
e2 chr1 4999 5999 201 0.201000 4999 5999 1
c1 chr1 1499 5499 700 0.175000 1499 5499 1
g2 chr1 7999 8500 100 0.199601 7999 8500 1
e3 chr1 7999 8500 100 0.199601 7999 8500 1
chr2reg chr2 0 50000 100 0.002000 0 50000 1
g3 chr2 1999 3000 660 0.659341 1999 3000 2
e4 chr2 1999 2500 500 0.998004 1999 2500 1
e5 chr2 2599 3000 61 0.152120 2599 3000 2
e6 chr2 2899 3000 10 0.099010 2899 3000 1"""


def test_coverage_and_depth(spark, demo):
    d, found = demo
    regions, rows = bed_lenient(spark, str(d / "demo.bed")), [x.split() for x in COVERAGE.split("\n")]
    write_table(c.coverage(found, regions), str(d / "coverage.tsv"), "fraction")
    write_table(c.depth(found, regions), str(d / "depth.tsv"))
    table = lambda head, cells: "\n".join(["\t".join(head.split()), *sorted("\t".join(x) for x in cells)]) + "\n"
    assert (d / "coverage.tsv").read_text() == table("id chr start end breadth fraction", [x[:6] for x in rows])
    assert (d / "depth.tsv").read_text() == table("id chr start end depth", [[x[0], x[1], *x[6:]] for x in rows])


@pytest.mark.parametrize("ratio, blocks", [(0.5, 2), (0.51, 4), (0, 0), (-1, 0), (float("nan"), 0), (1, 4), (7, 4)])
def test_sample(demo, ratio, blocks):
    assert c.sampled_roots(demo[1], ratio).count() == blocks
    if blocks == 4:
        assert numbers(c.sample(demo[1], ratio)) == span("3-17")


def test_lookups(demo):
    found = demo[1]
    at = lambda p: sorted(NUMBER[r.fid] for r in c.roots_at(found, "chr1", p).collect())
    assert at(999) == [3] and at(998) == [] and at(9000) == [3] and at(8000) == [3, 10]
    assert {NUMBER[r.fid] for r in c.roots_of_sequence(found, "chr2").collect()} == {13, 15}
    assert NUMBER[c.parent_of(found, 137).first().par] == 4
    assert [r.id for r in c.values_of(found, value="BETA").collect()] == ["g2"] and c.values_of(found, 75).first().attr == "ALPHA"


def test_output_is_the_input_byte_for_byte(spark, demo):
    d, found = demo
    assert write_lines(c.sample(found, 1.0), str(d / "all.gff")) == 15
    assert (d / "all.gff").read_bytes() == TEXT.encode()[23:]


def test_saved_tables(spark, demo):
    d, _ = demo
    assert missing_tables(spark, f"file://{d}/index") == [] and missing_tables(spark, f"file://{d}/none") == ["lines", "links", "roots", "about"]
    assert Annotation.load(spark, f"file://{d}/index").attribute == "gene_name"


@pytest.mark.parametrize("line", ["chr1\ts\tgene\t1\t2\t.\t+\t.", "chr1\ts\tgene\t1\t2\t.\t+\t.\tName=x", "chr1\ts\tgene\tx\t2\t.\t+\t.\tID=a", "chr1\ts\tgene\t-1\t2\t.\t+\t.\tID=a", "chr1\ts\tgene\t4294967296\t2\t.\t+\t.\tID=a", "chr1\ts\tgene\t1\t2\t.\t+\t.\tID=a\tmore"])
def test_bad_lines(spark, tmp_path, line):
    (tmp_path / "bad.gff").write_text(TEXT + line + "\n")
    with pytest.raises(BadAnnotation):
        build_index(spark, str(tmp_path / "bad.gff"))
