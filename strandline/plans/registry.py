"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.intervals import merged, overlapping, union_length
from strandline.plans import commands as c
from strandline.plans.model import feature_rows
from strandline.plans.views import annotation, annotation_lines, regions
from strandline.session import shared_folder
from strandline.sources.annotation import save_table
from strandline.sources.regions import bed_strict, literal_region, read_list, read_regions
from strandline.streaming.depth import replayed_depth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_BASE = """
WITH RECURSIVE raw AS (
  SELECT o_orderkey AS k, 0 AS ln, 0 AS pk, 0 AS sk, 'chr' || CAST(o_custkey % 5 AS VARCHAR) AS seqid, 'gene' AS type,
         o_orderkey * 100 + 1 AS s1, o_orderkey * 100 + 50 + (o_orderkey * 37) % 400 AS e1,
         'g' || CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent,
         o_orderpriority || '_' || CAST(o_custkey % 50 AS VARCHAR) AS attr
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'chr' || CAST(o_custkey % 5 AS VARCHAR),
         CASE l_returnflag WHEN 'A' THEN 'exon' WHEN 'N' THEN 'CDS' ELSE 'mRNA' END,
         l_orderkey * 100 + 1 + l_partkey % 50, l_orderkey * 100 + 1 + l_partkey % 50 + CAST(l_quantity AS BIGINT),
         'x' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR),
         CASE WHEN l_linenumber % 2 = 0 THEN 'x' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber - 1 AS VARCHAR)
              ELSE 'g' || CAST(l_orderkey AS VARCHAR) END, NULL
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), placed AS (
  SELECT *, k * 1000 + row_number() OVER (PARTITION BY k ORDER BY ln, pk, sk, e1, type) - 1 AS off,
         greatest(least(s1, e1) - 1, 0) AS s0, greatest(s1, e1) AS e0 FROM raw
), numbered AS (SELECT *, max(off) OVER (PARTITION BY id) AS fid FROM placed
), idmap AS (SELECT DISTINCT id, fid FROM numbered
), links AS (SELECT n.*, coalesce(p.fid, n.fid) AS par FROM numbered n LEFT JOIN idmap p ON n.parent = p.id
), roots AS (SELECT off AS b0, fid, seqid, s0, e0, k FROM links WHERE par = fid
), gof AS (SELECT fid, max(b0) AS b0 FROM roots GROUP BY fid
), blocked AS (
  SELECT l.*, max(CASE WHEN par = fid THEN off END) OVER (ORDER BY off) AS b0 FROM links l
), lines AS (
  SELECT b.off, b.seqid, b.type, b.s1, b.e1, b.s0, b.e0, b.id, b.attr, g.fid AS root FROM blocked b JOIN gof g ON b.b0 = g.b0
), reg AS (
  SELECT event_id AS rid, 'chr' || CAST(user_id % 5 AS VARCHAR) AS seqid, event_id * 150 AS qs,
         event_id * 150 + 1 + CAST(floor(value) AS BIGINT) AS qe FROM events WHERE event_type <> 'error'
), hit AS (
  SELECT r.fid, r.s0, r.e0, g.rid, g.qs, g.qe FROM roots r JOIN reg g ON r.seqid = g.seqid AND r.s0 < g.qe AND r.e0 > g.qs
), pair AS (SELECT DISTINCT rid, fid, qs, qe FROM hit WHERE qs < qe
), climb AS (
  SELECT off AS node, par AS up FROM links UNION ALL
  SELECT climb.node, links.par FROM climb JOIN links ON climb.up = links.off WHERE links.par <> links.off
), rooted AS (
  SELECT climb.node, links.off AS root FROM climb JOIN links ON climb.up = links.off AND links.par = links.off
), met AS (
  SELECT l.root, l.id, l.off, l.seqid, l.s0, l.e0, p.rid, greatest(l.s0, p.qs) AS a, least(l.e0, p.qe) AS b
  FROM lines l JOIN pair p ON l.root = p.fid AND l.s0 < p.qe AND l.e0 > p.qs
), named AS (SELECT root, id, arg_min(seqid, off) AS chr, min(off) AS first, min(s0) AS s, max(e0) AS e FROM lines GROUP BY root, id
), deep AS (
  SELECT m.id, arg_min(n.chr, n.first) AS chr, min(m.s) AS "start", max(m.e) AS "end", CAST(sum(m.d) AS BIGINT) AS depth
  FROM (SELECT root, id, min(s0) AS s, max(e0) AS e, count(DISTINCT rid) AS d FROM met GROUP BY root, id) m
  JOIN named n ON m.root = n.root AND m.id = n.id GROUP BY m.id
), ahead AS (
  SELECT root, id, a, b, max(b) OVER (PARTITION BY root, id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM met
), lengths AS (
  SELECT root, id, sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS n FROM ahead GROUP BY root, id
), broad AS (
  SELECT n.id, arg_min(n.chr, n.first) AS chr, min(n.s) AS "start", max(n.e) AS "end", CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS breadth
  FROM named n JOIN (SELECT DISTINCT fid FROM pair) p ON n.root = p.fid LEFT JOIN lengths l ON n.root = l.root AND n.id = l.id GROUP BY n.id
)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (_BASE if base else "") + sql
        return f

    return add


def _offs(lines: DataFrame) -> DataFrame:
    return lines.select("off")


@query("features_linked", "SELECT off, fid, par, id, parent, attr, seqid, s0, e0 FROM links")
def features_linked(spark, d):
    return annotation(spark, d).links.select("off", "fid", "par", "id", "parent", "attr", "seqid", "s0", "e0")


@query("roots_by_type", "SELECT type, count(*)::BIGINT AS n FROM links WHERE par = fid GROUP BY type")
def roots_by_type(spark, d):
    found = annotation(spark, d)
    return found.lines.join(found.spans.select(F.col("b0").alias("off")), "off").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("roots_per_seqid", "SELECT seqid, count(DISTINCT fid)::BIGINT AS n FROM roots GROUP BY seqid")
def roots_per_seqid(spark, d):
    return annotation(spark, d).spans.groupBy("seqid").agg(F.count_distinct("fid").alias("n"))


@query("hierarchy_root", "SELECT node, root FROM rooted")
def hierarchy_root(spark, d):
    return annotation(spark, d).roots.select("node", "root")


@query("block_extents", "SELECT fid, seqid, b0, coalesce(lead(b0) OVER (ORDER BY b0), (SELECT max(off) + 1 FROM placed)) AS b1 FROM roots")
def block_extents(spark, d):
    from strandline.plans.model import block_extents as extents

    found = annotation(spark, d)
    # these offsets count lines, so the file ends one after its last line
    return extents(found.spans, found.lines.agg((F.max("off") + 1).alias("end")))


@query("parent_lookup", "SELECT c.off, c.id, p.id AS parent_id FROM links c JOIN links p ON c.par = p.off WHERE c.par <> c.off")
def parent_lookup(spark, d):
    links = annotation(spark, d).links
    return links.filter("par <> off").select("off", "id", "par").join(links.select(F.col("off").alias("par"), F.col("id").alias("parent_id")), "par").select("off", "id", "parent_id")


@query("root_region_hits", "SELECT fid, s0, e0, rid FROM hit")
def root_region_hits(spark, d):
    return c.hits(annotation(spark, d), regions(spark, d)).select("fid", "s0", "e0", "rid")


_MEETS = {
    "overlap": "((qs <= s1 AND s1 <= qe) OR (qs <= e1 AND e1 <= qe) OR (s1 <= qs AND qs <= e1) OR (s1 <= qe AND qe <= e1))",
    "contained": "(s1 >= qs AND e1 <= qe)",
    "contains": "(s1 <= qs AND e1 >= qe)",
}
_FINDS = {"overlap": "true", "contained": "(s0 >= qs AND e0 <= qe)", "contains": "(s0 <= qs AND e0 >= qe)"}


def _entire_sql(mode: str, invert: bool) -> str:
    return f"SELECT off FROM lines WHERE root IN (SELECT fid FROM hit WHERE {'NOT ' * invert}{_FINDS[mode]})"


def _match_sql(mode: str, types: str = "") -> str:
    return _entire_sql(mode, False) + types + f" AND EXISTS (SELECT 1 FROM reg WHERE reg.seqid = lines.seqid AND {_MEETS[mode]} AND reg.seqid IN (SELECT seqid FROM roots))"


# overlap inverted is empty by definition, here as in the SQL: the roots asked are those that overlap a region
for _mode in c.MODES:
    query(f"intersect_{_mode}_match", _match_sql(_mode))(lambda spark, d, m=_mode: _offs(c.intersect(annotation(spark, d), regions(spark, d), m)))
    query(f"intersect_{_mode}_entire", _entire_sql(_mode, False))(lambda spark, d, m=_mode: _offs(c.intersect(annotation(spark, d), regions(spark, d), m, entire=True)))
    query(f"intersect_{_mode}_invert_entire", _entire_sql(_mode, True))(lambda spark, d, m=_mode: _offs(c.intersect(annotation(spark, d), regions(spark, d), m, invert=True, entire=True)))
query("intersect_types", _match_sql("overlap", " AND type IN ('exon', 'CDS')"))(lambda spark, d: _offs(c.intersect(annotation(spark, d), regions(spark, d), types="exon, CDS")))


@query("intersect_region", f"""SELECT off FROM lines WHERE root IN (SELECT fid FROM roots WHERE seqid = 'chr3' AND s0 < 90000 AND e0 > 20000)
  AND seqid = 'chr3' AND {_MEETS['overlap'].replace('qs', '20000').replace('qe', '90000')}""")
def intersect_region(spark, d):
    return _offs(c.intersect(annotation(spark, d), literal_region(spark, "chr3:20000-90000")))


_LARGE = "SELECT DISTINCT 'x' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS value FROM lineitem WHERE l_quantity >= 40"
_KEEP = f", want AS ({_LARGE}), keep AS (SELECT DISTINCT r.root AS fid, m.id AS value FROM idmap m JOIN want ON m.id = want.value JOIN rooted r ON r.node = m.fid)"


def _large_items(spark, d):
    """Ids of items ordered in large numbers: the list that is asked for."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity >= 40")
    return rows.select(F.concat(F.lit("x"), "l_orderkey", F.lit("."), "l_linenumber").alias("value")).distinct()


@query("extract_match", _KEEP + " SELECT off FROM lines JOIN keep ON lines.root = keep.fid AND lines.id = keep.value")
def extract_match(spark, d):
    return _offs(c.extract(annotation(spark, d), _large_items(spark, d)))


@query("extract_entire", _KEEP + " SELECT off FROM lines WHERE root IN (SELECT fid FROM keep)")
def extract_entire(spark, d):
    return _offs(c.extract(annotation(spark, d), _large_items(spark, d), entire=True))


@query("extract_types", _KEEP + " SELECT off FROM lines JOIN keep ON lines.root = keep.fid AND lines.id = keep.value WHERE type = 'exon'")
def extract_types(spark, d):
    return _offs(c.extract(annotation(spark, d), _large_items(spark, d), types="exon"))


@query("extract_missing", " SELECT value FROM (SELECT DISTINCT 'x' || CAST(event_id AS VARCHAR) || '.1' AS value FROM events) WHERE value NOT IN (SELECT id FROM links)")
def extract_missing(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("x"), "event_id", F.lit(".1")).alias("value"))
    return c.missing_ids(annotation(spark, d), ids)


def _found_sql(test: str, rest: str) -> str:
    return f", keep AS (SELECT DISTINCT r.root AS fid, l.attr AS value FROM links l JOIN rooted r ON r.node = l.off WHERE {test}) {rest}"


_OF_VALUE = "SELECT off FROM lines JOIN keep ON lines.root = keep.fid AND lines.attr = keep.value"
_URGENT = "l.attr IN (SELECT '1-URGENT_' || CAST(n_nationkey AS VARCHAR) FROM nation)"


def _urgent(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("1-URGENT_"), "n_nationkey").alias("value"))


@query("search_exact", _found_sql(_URGENT, _OF_VALUE))
def search_exact(spark, d):
    return _offs(c.search(annotation(spark, d), table=_urgent(spark, d)))


@query("search_regex", _found_sql("regexp_matches(l.attr, '^[12]-.*_(1|2)[0-9]$|LOW_7')", _OF_VALUE))
def search_regex(spark, d):
    return _offs(c.search(annotation(spark, d), patterns=["^[12]-.*_(1|2)[0-9]$", "LOW_7"]))


@query("search_entire", _found_sql(_URGENT, "SELECT off FROM lines WHERE root IN (SELECT fid FROM keep)"))
def search_entire(spark, d):
    return _offs(c.search(annotation(spark, d), table=_urgent(spark, d), entire=True))


@query("coverage_breadth", 'SELECT id, chr, "start", "end", breadth FROM broad')
def coverage_breadth(spark, d):
    return c.coverage(annotation(spark, d), regions(spark, d)).drop("fraction")


@query("coverage_fraction", 'SELECT id, CASE WHEN "end" > "start" THEN CAST(breadth AS DOUBLE) / ("end" - "start") ELSE 0 END AS fraction FROM broad')
def coverage_fraction(spark, d):
    return c.coverage(annotation(spark, d), regions(spark, d)).select("id", "fraction")


@query("depth", "SELECT * FROM deep")
def depth(spark, d):
    return c.depth(annotation(spark, d), regions(spark, d))


@query("depth_by_type", "SELECT t.type, count(*)::BIGINT AS n, sum(deep.depth)::BIGINT AS depth FROM deep JOIN (SELECT id, arg_min(type, off) AS type FROM links GROUP BY id) t ON deep.id = t.id GROUP BY t.type")
def depth_by_type(spark, d):
    found = annotation(spark, d)
    kinds = found.lines.groupBy("id").agg(F.min_by("type", "off").alias("type"))
    return c.depth(found, regions(spark, d)).join(kinds, "id").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"))


@query("depth_streamed", "SELECT * FROM deep")
def depth_streamed(spark, d):
    return replayed_depth(annotation(spark, d), regions(spark, d))


@query("sample_md5", """SELECT off FROM lines WHERE root IN (SELECT fid FROM (
  SELECT fid, row_number() OVER (PARTITION BY seqid ORDER BY md5(CAST(fid AS VARCHAR) || '|42'), b0) AS place,
         ceil(CAST(count(*) OVER (PARTITION BY seqid) AS FLOAT) * CAST(0.1 AS FLOAT)) AS wanted FROM roots) WHERE place <= wanted)""")
def sample_md5(spark, d):
    return _offs(c.sample(annotation(spark, d), 0.1))


@query("point_query", "SELECT g.rid, r.fid, r.s0, r.e0 FROM roots r JOIN reg g ON r.seqid = g.seqid AND r.s0 <= g.qs AND g.qs <= r.e0")
def point_query(spark, d):
    points = regions(spark, d).select("rid", "seqid", F.col("qs").alias("point"))
    return c.roots_at_points(annotation(spark, d), points).select("rid", "fid", "s0", "e0")


@query("merged_regions", """, steps AS (SELECT *, CASE WHEN max(qe) OVER (PARTITION BY seqid ORDER BY qs, qe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= qs THEN 0 ELSE 1 END AS fresh FROM reg),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY seqid ORDER BY qs, qe ROWS UNBOUNDED PRECEDING) AS island FROM steps)
  SELECT seqid, min(qs) AS qs, max(qe) AS qe FROM islands GROUP BY seqid, island""")
def merged_regions(spark, d):
    return merged(regions(spark, d), ["seqid"], "qs", "qe")


@query("covered_per_seqid", """, steps AS (SELECT *, max(qe) OVER (PARTITION BY seqid ORDER BY qs, qe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reg)
  SELECT seqid, sum(greatest(qe - greatest(qs, coalesce(reach, qs)), 0))::BIGINT AS covered FROM steps GROUP BY seqid""")
def covered_per_seqid(spark, d):
    return union_length(regions(spark, d), ["seqid"], "qs", "qe", "covered")


@query("regions_per_root", "SELECT fid, count(*)::BIGINT AS n FROM pair GROUP BY fid")
def regions_per_root(spark, d):
    pairs = overlapping(annotation(spark, d).spans.select("seqid", "fid", "s0", "e0"), regions(spark, d), "seqid")
    return pairs.select("rid", "fid").distinct().groupBy("fid").agg(F.count(F.lit(1)).alias("n"))


# --- the same by way of text files, which are written to the shared folder and read back ------------------------------


def _as_text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}/{name}"
    lines.write.option("lineSep", "\n").text(path)
    return path


def _bed(spark: SparkSession, d: str) -> str:
    """Regions as BED: tabs or blanks between fields, more fields on some lines, comments among them."""
    gap = F.when(F.col("rid") % 2 == 0, "\t").otherwise("  ")
    line = F.concat("seqid", gap, F.col("qs").cast("string"), gap, F.col("qe").cast("string"), F.when(F.col("rid") % 3 == 0, F.concat(gap, F.lit("name"))).otherwise(""))
    found = regions(spark, d).select(line.alias("value"))
    return _as_text(spark, found.unionByName(spark.createDataFrame([("# comment",), ("",), ("chr1 5",), ("unheard\t1\t9",)], "value string")), "regions.bed")


@query("bed_strict_regions", "SELECT seqid, qs, qe, count(*)::BIGINT AS n FROM reg WHERE seqid IN (SELECT seqid FROM roots) GROUP BY seqid, qs, qe")
def bed_strict_regions(spark, d):
    return bed_strict(spark, _bed(spark, d), annotation(spark, d).seqids).groupBy("seqid", "qs", "qe").agg(F.count(F.lit(1)).alias("n"))


@query("depth_from_bed", "SELECT * FROM deep")
def depth_from_bed(spark, d):
    return c.depth(annotation(spark, d), read_regions(spark, _bed(spark, d)))


@query("depth_from_sam", "SELECT * FROM deep")
def depth_from_sam(spark, d):
    """Events as alignments, errors as unmapped ones; spans are made of matches, gaps and clipped ends that don't count."""
    events = spark.read.parquet(f"{d}/events.parquet")
    length = 1 + F.floor("value")
    first = F.floor(length / 2)
    cigar = F.concat(F.lit("3S"), F.when(first > 0, F.concat(first.cast("string"), F.lit("M2I"))).otherwise(""), (length - first).cast("string"), F.lit("N4H"))
    cells = ["event_id", F.when(F.col("event_type") == "error", "4").otherwise("16"), F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")), (F.col("event_id") * 150 + 1).cast("string"), F.lit("0"), cigar, *map(F.lit, "*00**")]
    lines = events.select(F.concat_ws("\t", *cells).alias("value")).unionByName(spark.createDataFrame([("@HD\tVN:1.6",)], "value string"))
    return c.depth(annotation(spark, d), read_regions(spark, _as_text(spark, lines, "reads.sam")))


@query("extract_from_list", _KEEP + " SELECT off FROM lines JOIN keep ON lines.root = keep.fid AND lines.id = keep.value")
def extract_from_list(spark, d):
    lines = _large_items(spark, d).select(F.concat(F.lit(" "), "value", F.lit("\t\r")).alias("value")).unionByName(spark.createDataFrame([("",), ("  ",)], "value string"))
    return _offs(c.extract(annotation(spark, d), read_list(spark, _as_text(spark, lines, "ids.txt"))))


@query("features_without_skipped_types", "SELECT off, id, parent, attr FROM placed WHERE type NOT IN ('CDS', 'exon')")
def features_without_skipped_types(spark, d):
    return feature_rows(annotation_lines(spark, d), skip_types="CDS,exon").select("off", "id", "parent", "attr")


@query("coverage_cells", """SELECT id, chr, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end", CAST(breadth AS VARCHAR) AS breadth,
  printf('%.6f', CASE WHEN "end" > "start" THEN CAST(breadth AS DOUBLE) / ("end" - "start") ELSE 0.0 END) AS fraction FROM broad""")
def coverage_cells(spark, d):
    """The written table, cell by cell as text."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}/coverage.tsv"
    save_table(c.coverage(annotation(spark, d), regions(spark, d)), path, "fraction")
    return spark.read.option("sep", "\t").option("header", True).csv(path)
