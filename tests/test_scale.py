"""What is moved between tasks, and that parts of a text which depend on others are indexed as before."""

import pytest
from pyspark.sql import functions as F

from strandline.operators.hierarchy import resolve_roots
from strandline.operators.intervals import touching
from strandline.plans import commands as c
from strandline.plans import registry
from strandline.plans.model import Annotation, from_lines
from strandline.plans.views import annotation, annotation_lines, regions
from tests.oracle import DATA, needs_data


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def text(spark, odd=None):
    """Forty groups in four parts. ``odd``: a part begins inside a group, or a parent or an id stands in another part."""
    line = lambda kind, at, attrs: f"chr{at % 3}\ts\t{kind}\t{at * 100 + 1}\t{at * 100 + 90}\t.\t+\t.\t{attrs}"
    rows = [(0, "##gff-version 3")]
    for i in range(40):
        part = i // 10
        rows += [(part, line("gene", i, f"ID=g{i};gene_name=n{i % 4}"))]
        rows += [(part + (odd == "cut" and i == 19), line("exon", i, f"ID=x{i}.1;Parent=g{i}"))]
        rows += [(part + (odd == "cut" and i == 19), line("CDS", i, f"ID=x{i}.2;Parent=" + ("g31" if odd == "parent" and i == 3 else f"x{i}.1")))]
        rows += [(part + (odd == "cut" and i == 19), x) for x in (line("CDS", i, f"ID=x{i}.2;Parent=x{i}.1"), "# note", line("exon", i, f"ID=y{i % 2};Parent=none") if i % 10 == 9 and odd == "id" else line("region", i, f"ID=r{i}"))]
    return spark.createDataFrame([(p, n * 100, x, "\n") for n, (p, x) in enumerate(rows)], "part long, off long, line string, eol string")


def table(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=repr)


@pytest.mark.parametrize("odd", [None, "cut", "parent", "id"])
def test_parts_are_indexed_alone_only_if_they_stand_alone(spark, tmp_path, odd):
    found = from_lines(text(spark, odd), check=False)
    kept = found.save(f"file://{tmp_path}/index")
    assert table(kept.lines.select(found.lines.columns)) == table(found.lines) and table(kept.links) == table(found.links) and table(kept.roots) == table(found.roots)
    assert spark.read.parquet(f"file://{tmp_path}/index/about").first().together == (odd is None)
    assert table(Annotation.load(spark, f"file://{tmp_path}/index").block_lines) == table(kept.block_lines)


def test_roots_of_numbers_far_apart(spark):
    far = 1 << 24
    chain = [(0, 0)] + [(i * far, (i - 1) * far) for i in range(1, 40)] + [(i * far + 1, i * far) for i in range(40)] + [(7, 8), (8, 7), (far + 9, 2 * far + 9), (2 * far + 9, far + 9)]
    got = {x.node: x.root for x in resolve_roots(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert got == {n: None if n in (7, 8, far + 9, 2 * far + 9) else 0 for n, _ in chain}


@pytest.mark.parametrize("many", [0, 2])
def test_roots_with_many_regions(spark, monkeypatch, many):
    found = from_lines(text(spark), check=False)
    places = spark.range(400).select(F.col("id").alias("rid"), F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("seqid"), (F.col("id") * F.col("id") % 4000).alias("qs"))
    places = places.withColumn("qe", F.col("qs") + 1 + F.col("rid") % 70)
    want = table(c.depth(found, places)), table(c.coverage(found, places))
    monkeypatch.setattr(c, "MANY", many)
    assert (table(c.depth(found, places)), table(c.coverage(found, places))) == want and len(want[0]) > 50


@needs_data
def test_lines_are_dealt_once(spark):
    assert exchanges(annotation_lines(spark, DATA)) == 1
    found, places = annotation(spark, DATA), regions(spark, DATA)
    assert len(found.lines.inputFiles()) and found.lines.inputFiles()[0].split("/")[-2] == "rows"
    assert exchanges(c.depth(found, places)) <= 3 and exchanges(c.coverage(found, places)) <= 3
    for name, most in {"depth_from_bed": 3, "depth_from_sam": 3, "depth_by_type": 5}.items():
        assert exchanges(registry.QUERIES[name](spark, DATA)) <= most, name


def test_levels_are_found_without_the_joined_lines(spark):
    """Lines of matched roots come from a join, which isn't made a second time for the levels; spans of 50 to 600 are of one level."""
    places = spark.range(100).select(F.lit("a").alias("k"), (F.col("id") * 700).alias("qs"), (F.col("id") * 705 + 600).alias("qe"))
    among = spark.range(300).select(F.col("id").alias("i"), F.lit("a").alias("k"), (F.col("id") * 300).alias("s1"), (F.col("id") * 301 + 50).alias("e1"))
    test = (F.col("s1") <= F.col("qe")) & (F.col("e1") >= F.col("qs"))
    joined = among.withColumn("s1", F.when(F.col("s1") >= 0, F.raise_error(F.lit("read twice"))).cast("long"))
    plan = touching(joined, places, "k", test, "i", among=among)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 1
    got = {x.i for x in touching(among, places, "k", test, "i", among=among).collect()}
    assert got == {i for i in range(300) if any(i * 300 <= j * 705 + 600 and i * 301 + 50 >= j * 700 for j in range(100))}
