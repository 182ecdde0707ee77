"""What can be asked of an annotation: intersect, extract, search, coverage, depth, sample, and lookups."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.functions.fields import any_pattern, first_value
from strandline.operators.intervals import covering_point, overlapping, touching, union_length
from strandline.plans.model import Annotation
from strandline.session import cut

MODES = ("overlap", "contained", "contains")


class NothingMatched(LookupError):
    """A search without a result."""


def type_list(types: str | None) -> list[str] | None:
    return None if types is None else [t for t in (x.strip() for x in types.split(",")) if t]


def _of_types(lines: DataFrame, types: str | None) -> DataFrame:
    wanted = type_list(types)
    return lines if wanted is None else lines.filter(F.col("type").isin(wanted) if wanted else F.lit(False))


def _mode(mode: str, start: str, end: str, closed: bool) -> Column:
    """Of a feature's bounds against qs and qe. The closed overlap is written out in its four cases: bounds may be reversed."""
    s, e, qs, qe = map(F.col, (start, end, "qs", "qe"))
    if mode == "contained":
        return (s >= qs) & (e <= qe)
    if mode == "contains":
        return (s <= qs) & (e >= qe)
    if mode != "overlap":
        raise ValueError(f"mode has to be one of {MODES}")
    return ((qs <= s) & (s <= qe)) | ((qs <= e) & (e <= qe)) | ((s <= qs) & (qs <= e)) | ((s <= qe) & (qe <= e)) if closed else F.lit(True)


def hits(found: Annotation, regions: DataFrame) -> DataFrame:
    """Pairs of root spans and regions (rid, seqid, qs, qe) that overlap, half-open."""
    return overlapping(found.spans.select("seqid", "fid", "s0", "e0"), regions.select("rid", "seqid", "qs", "qe"), "seqid")


def matched_roots(found: Annotation, regions: DataFrame, mode: str = "overlap", invert: bool = False) -> DataFrame:
    """fid of the roots that some overlapping region finds in the mode, or doesn't find if inverted."""
    keep = _mode(mode, "s0", "e0", closed=False)
    return hits(found, regions).filter(~keep if invert else keep).select("fid").distinct()


def whole_blocks(found: Annotation, roots: DataFrame) -> DataFrame:
    """Every line of the blocks of the given fid, comments and skipped types among them."""
    return found.block_lines.join(roots.select("fid").distinct(), "fid", "left_semi")


def intersect(found: Annotation, regions: DataFrame, mode: str = "overlap", invert: bool = False, entire: bool = False, types: str | None = None) -> DataFrame:
    """Lines (off, line, eol) of roots that regions select: the whole blocks, or the lines that some region on their sequence meets.

    The second test uses the numbers as they stand, both ends included, any region, and isn't inverted.
    """
    roots = matched_roots(found, regions, mode, invert)
    lines = whole_blocks(found, roots)
    if not entire or types is not None:
        known = regions.join(found.seqids, "seqid", "left_semi").select("seqid", "qs", "qe").distinct()
        bounded = lambda df: _of_types(df.filter("data AND s1 IS NOT NULL AND e1 IS NOT NULL"), types)
        lines = bounded(lines).select("off", "line", "eol", "seqid", "s1", "e1")
        lines = touching(lines, known, "seqid", _mode(mode, "s1", "e1", closed=True), "off", among=bounded(found.block_lines))
    return lines.select("off", "line", "eol")


def _kept_lines(found: Annotation, keep: DataFrame, key: str, types: str | None) -> DataFrame:
    """Lines of the kept roots' blocks whose first ``key=`` in the attributes has a value to keep. ``keep``: fid, value."""
    lines = _of_types(found.block_lines.filter("data"), types)
    lines = lines.withColumn("value", first_value(F.regexp_replace("attrs", r"\r\z", ""), key, ";"))
    return lines.join(keep.select("fid", "value").distinct(), ["fid", "value"], "left_semi").select("off", "line", "eol")


def _selected(found: Annotation, keep: DataFrame, key: str, entire: bool, types: str | None) -> DataFrame:
    if entire and types is None:
        return whole_blocks(found, keep).select("off", "line", "eol")
    return _kept_lines(found, keep, key, types)


def extract_roots(found: Annotation, ids: DataFrame) -> DataFrame:
    """fid (of the root) and value (the id) for each known id (value)."""
    numbers = found.links.join(ids.select(F.col("value").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.max("off").alias("node"))
    return numbers.join(found.roots, "node").filter("root IS NOT NULL").select(F.col("root").alias("fid"), F.col("id").alias("value"))


def missing_ids(found: Annotation, ids: DataFrame) -> DataFrame:
    """Requested ids that no feature has."""
    return ids.select("value").distinct().join(found.links.select(F.col("id").alias("value")), "value", "left_anti")


def rootless(found: Annotation) -> DataFrame:
    """(off, id) of features whose parents lead to no root."""
    return found.links.select("off", "id").join(found.roots.filter("root IS NULL").select(F.col("node").alias("off")), "off", "left_semi")


def _warn_rootless(found: Annotation, wanted: DataFrame, column: str) -> None:
    if n := rootless(found).join(found.links.select("off", column).join(wanted.select(F.col("value").alias(column)).distinct(), column, "left_semi"), "off", "left_semi").count():
        warnings.warn(f"{n} of the features found have no root: their parents form a cycle", stacklevel=3)


def extract(found: Annotation, ids: DataFrame, entire: bool = False, types: str | None = None, warn: bool = False) -> DataFrame:
    """Lines of the features with the given ids (value), or of their whole groups.

    A root is found through parents; what comes out stands in the root's own block.
    """
    if warn and (n := missing_ids(found, ids).count()):
        warnings.warn(f"{n} of the requested ids are in no feature", stacklevel=2)
    if warn:
        _warn_rootless(found, ids, "id")
    return _selected(found, extract_roots(found, ids), "ID", entire, types)


def _with_value(found: Annotation, values: list[str] | None, patterns: list[str] | None, table: DataFrame | None) -> DataFrame:
    """node and value of the features whose indexed attribute is asked for."""
    rows = found.links.filter("attr IS NOT NULL").select(F.col("off").alias("node"), F.col("attr").alias("value"))
    if patterns is not None:
        return rows.filter(F.col("value").rlike(any_pattern(patterns)) if patterns else F.lit(False))
    return rows.filter(F.col("value").isin(values or [])) if table is None else rows.join(table.select("value").distinct(), "value", "left_semi")


def search_roots(found: Annotation, values: list[str] | None = None, patterns: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """fid (of the root) and value for each feature whose indexed attribute is among ``values`` or ``table`` (value), or matches a pattern somewhere."""
    rows = _with_value(found, values, patterns, table)
    return rows.join(found.roots, "node").filter("root IS NOT NULL").select(F.col("root").alias("fid"), "value").distinct()


def search(found: Annotation, values: list[str] | None = None, patterns: list[str] | None = None, table: DataFrame | None = None, entire: bool = False, types: str | None = None, strict: bool = False, warn: bool = False) -> DataFrame:
    """Lines of the features with the attribute, or their whole groups. With ``strict`` nothing found is an error; with ``warn`` features without a root are told of."""
    if warn:
        _warn_rootless(found, _with_value(found, values, patterns, table), "attr")
    keep = search_roots(found, values, patterns, table)
    if strict and keep.isEmpty():
        raise NothingMatched("no attribute matched")
    return _selected(found, keep, found.attribute, entire, types)


#: A root with more regions than this has its lines joined by bins, so that large blocks aren't compared row by row. Lines of
#: the others meet their root's regions by its number alone, and all that is grouped by root next stays where it is.
MANY = 64


def _pairs(found: Annotation, regions: DataFrame) -> DataFrame:
    """(rid, fid, qs, qe, n): each region once with each root it overlaps, and how many the root has. A region may have several spans of a root."""
    pairs = hits(found, regions.filter("qs < qe")).select("rid", "fid", "qs", "qe").repartition("fid").distinct()
    return cut(pairs.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("fid"))))


def _block_features(found: Annotation) -> DataFrame:
    """Lines of reachable blocks that have an id and bounds, skipped types among them: fid, id, off, seqid, s0, e0.

    A block with a line that isn't UTF-8, a comment for instance, has none.
    """
    unread = found.block_lines.filter("bad").select("fid").distinct()
    rows = found.block_lines if unread.isEmpty() else found.block_lines.join(unread, "fid", "left_anti")
    rows = rows.filter("data AND id IS NOT NULL AND s1 IS NOT NULL AND e1 IS NOT NULL AND e1 <> 0")
    return rows.select("fid", "id", "off", "seqid", F.greatest(F.least("s1", "e1") - 1, F.lit(0)).alias("s0"), F.greatest("s1", "e1").alias("e0"))


def merged_roots(partial: DataFrame, measure: str) -> DataFrame:
    """Partial results of one id, as of several roots: the sequence and place (``first``) of its first line, the widest bounds, the sum."""
    out = partial.groupBy("id").agg(F.min_by("chr", "first").alias("chr"), F.min("first").alias("first"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(measure).alias(measure))
    return out.select("id", "chr", "first", "start", "end", F.col(measure).cast("long").alias(measure))


def _depth_by_bins(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    met = overlapping(rows, pairs, "fid")
    # one row per region first, so that counting needs no further distinct
    each = met.groupBy("fid", "id", "rid").agg(F.min("s0").alias("s"), F.max("e0").alias("e"))
    hit = each.groupBy("fid", "id").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count(F.lit(1)).alias("depth"))
    names = rows.join(pairs.select("fid").distinct(), "fid", "left_semi").groupBy("fid", "id").agg(F.min_by("seqid", "off").alias("chr"), F.min("off").alias("first"))
    return hit.join(names, ["fid", "id"]).select("fid", "id", "start", "end", "depth", "chr", "first")


def _depth_within_roots(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each line with all regions of its root, of which some hit it: a line's place counts even if none does."""
    met = rows.join(pairs, "fid").withColumn("hit", (F.col("s0") < F.col("qe")) & (F.col("e0") > F.col("qs")))
    of_hits = lambda c: F.when(F.col("hit"), F.col(c))
    each = met.groupBy("fid", "id", "rid").agg(F.min(of_hits("s0")).alias("s"), F.max(of_hits("e0")).alias("e"), F.min_by("seqid", "off").alias("chr"), F.min("off").alias("first"))
    hit = each.groupBy("fid", "id").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count("s").alias("depth"), F.first("chr").alias("chr"), F.first("first").alias("first"))
    return hit.filter("depth > 0")


def depth_by_root(found: Annotation, regions: DataFrame) -> DataFrame:
    """fid, id, chr, first, start, end, depth: distinct regions that hit any line with the id, bounds of the lines hit."""
    rows, pairs = _block_features(found), _pairs(found, regions)
    out, many = _depth_within_roots(rows, pairs.filter(F.col("n") <= MANY).drop("n")), pairs.filter(F.col("n") > MANY).drop("n")
    return out if many.isEmpty() else out.unionByName(_depth_by_bins(rows, many))


def depth(found: Annotation, regions: DataFrame) -> DataFrame:
    """How many regions hit each feature: id, chr, start, end, depth. Features without a hit aren't listed."""
    return merged_roots(depth_by_root(found, regions), "depth").drop("first")


def _coverage_by_bins(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = rows.join(pairs.select("fid").distinct(), "fid", "left_semi")
    spans = rows.groupBy("fid", "id").agg(F.min("s0").alias("start"), F.max("e0").alias("end"), F.min_by("seqid", "off").alias("chr"), F.min("off").alias("first"))
    pieces = overlapping(rows, pairs, "fid").select("fid", "id", F.greatest("s0", "qs").alias("a"), F.least("e0", "qe").alias("b"))
    lengths = union_length(pieces, ["fid", "id"], out="breadth")
    return spans.join(lengths, ["fid", "id"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))


def _coverage_within_roots(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each line with all regions of its root: a piece where they overlap, and the line's bounds in any case.

    Each piece adds what lies beyond all that began before it.
    """
    a, b = F.greatest("s0", "qs"), F.least("e0", "qe")
    met = rows.join(pairs, "fid").select("fid", "id", "off", "seqid", "s0", "e0", F.when(a < b, a).alias("a"), F.when(a < b, b).alias("b"))
    before = F.max("b").over(W.partitionBy("fid", "id").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.col("a"))), F.lit(0))
    out = met.withColumn("added", F.when(F.col("a").isNotNull(), added)).groupBy("fid", "id")
    return out.agg(F.min("s0").alias("start"), F.max("e0").alias("end"), F.min_by("seqid", "off").alias("chr"), F.min("off").alias("first"), F.coalesce(F.sum("added"), F.lit(0)).alias("breadth"))


def coverage(found: Annotation, regions: DataFrame) -> DataFrame:
    """How many bases of each feature regions cover: id, chr, start, end, breadth, fraction.

    Every id in a block that a region touches is listed, with the bounds of all its lines there.
    """
    rows, pairs = _block_features(found), _pairs(found, regions)
    per_root, many = _coverage_within_roots(rows, pairs.filter(F.col("n") <= MANY).drop("n")), pairs.filter(F.col("n") > MANY).drop("n")
    if not many.isEmpty():
        per_root = per_root.unionByName(_coverage_by_bins(rows, many))
    out = merged_roots(per_root, "breadth").drop("first")
    return out.withColumn("fraction", F.when(F.col("end") > F.col("start"), F.col("breadth") / (F.col("end") - F.col("start"))).otherwise(F.lit(0.0)))


def sampled_roots(found: Annotation, ratio: float, seed: str = "42") -> DataFrame:
    """Per sequence the ceiling of its number of blocks times the ratio, both as single floats, in the order of a hash of the number and the seed.

    Ranks are taken in two levels, by the hash's first digits and within them, so no sequence has to be sorted in one task.
    Ties (an id with several blocks) go by the block's place.
    """
    if math.isnan(ratio):
        ratio = 0.0
    drawn = found.spans.select("seqid", "fid", "b0", F.md5(F.concat(F.col("fid").cast("string"), F.lit(f"|{seed}"))).alias("h")).withColumn("digits", F.substring("h", 1, 3))
    counts = drawn.groupBy("seqid", "digits").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("seqid").orderBy("digits")
    counts = counts.select("seqid", "digits", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("seqid")).alias("all"))
    wanted = F.ceil(F.col("all").cast("float") * F.lit(ratio).cast("float"))
    ranked = drawn.join(counts.filter(F.col("before") < wanted), ["seqid", "digits"])
    place = F.col("before") + F.row_number().over(W.partitionBy("seqid", "digits").orderBy("h", "b0"))
    return ranked.withColumn("place", place).filter(F.col("place") <= wanted).select("fid").distinct()


def sample(found: Annotation, ratio: float, seed: str = "42") -> DataFrame:
    """Lines of a random share of each sequence's groups, the same for the same seed."""
    return whole_blocks(found, sampled_roots(found, ratio, seed)).select("off", "line", "eol")


def roots_at(found: Annotation, seqid: str, point: int) -> DataFrame:
    """Root spans that hold a position, both ends included."""
    return covering_point(found.spans.select("fid", "seqid", "s0", "e0"), "seqid", seqid, point)


def roots_of_sequence(found: Annotation, seqid: str) -> DataFrame:
    return found.spans.filter(F.col("seqid") == seqid).select("fid").distinct()


def parent_of(found: Annotation, number: int) -> DataFrame:
    """The number of a feature's parent, its own for a root."""
    return found.links.filter(F.col("off") == number).select("par")


def values_of(found: Annotation, number: int | None = None, value: str | None = None) -> DataFrame:
    """(off, id, attr) by a feature's number or by its attribute's value."""
    rows = found.links.select("off", "id", "attr")
    return rows.filter(F.col("off") == number) if value is None else rows.filter(F.col("attr") == value)


def roots_at_points(found: Annotation, points: DataFrame) -> DataFrame:
    """Root spans that hold each point (rid, seqid, point), both ends included."""
    spans = found.spans.select("seqid", "fid", "s0", "e0", (F.col("e0") + 1).alias("after"))
    return overlapping(spans, points.withColumn("beyond", F.col("point") + 1), "seqid", "s0", "after", "point", "beyond").drop("after", "beyond")
