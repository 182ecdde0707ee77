"""The tables of an annotation: features, links, spans of roots, blocks, and lines with the block they stand in.

A feature's number is the offset of its line; an id's number (``fid``) is that of its last feature, as a later row with the
same id replaces the earlier one.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.functions.fields import SPACE, indexed_value, once, trimmed, u32
from strandline.operators.hierarchy import far_roots, near_roots, resolve_roots
from strandline.session import cut
from strandline.sources.annotation import read_lines, with_columns_of_lines

# Fixed value: types that are skipped unless others are named.
SKIPPED = "remark,note,comment,region,gap,assembly_gap,contig,scaffold,source"
ATTRIBUTE = "gene_name"


class BadAnnotation(ValueError):
    """A line that an index can't be built from."""


def with_features(lines: DataFrame, attribute: str = ATTRIBUTE, skip_types: str = SKIPPED) -> DataFrame:
    """Adds ``feature`` to lines (off, line): the line read as a feature, null where it isn't one. It has seqid, s0, e0 (0-based, the end
    exclusive), id, parent, attr, and ``fault`` where one can't be read.

    White space around a line is dropped before it is parted; skipped types and features that end at 0 aren't features.
    Keys are found anywhere in the line.
    """
    names = lines.columns
    rows = lines.select("*", once(F.when((F.length("line") > 0) & ~F.startswith("line", F.lit("#")), trimmed(F.col("line")))).alias("_t"))
    rows = rows.select("*", once(F.split("_t", "\t", -1)).alias("_c"))
    at = lambda i: F.get("_c", F.lit(i))
    rows = rows.select(*names, "_t", F.size("_c").alias("_n"), at(0).alias("_seqid"), at(2).alias("_type"), u32(at(3), signed=True).alias("_s"), u32(at(4), signed=True).alias("_e"))
    skipped = (F.col("_n") == 9) & (F.coalesce("_type", F.lit("")).isin(skip_types.split(",")) | F.coalesce((F.col("_e") == 0) & F.col("_s").isNotNull(), F.lit(False)))
    line = F.when((F.col("_t") != "") & ~skipped, F.col("_t"))
    rows = rows.select(*names, "_n", "_seqid", "_s", "_e", once(line).alias("_t"))
    rows = rows.select("*", once(indexed_value(F.col("_t"), "ID", f";{SPACE}")).alias("_id"))
    s, e, line = F.col("_s"), F.col("_e"), F.col("_t")
    fault = F.when(F.col("_n") != 9, F.concat(F.lit("expected 9 columns: "), line)).when(s.isNull() | e.isNull(), F.concat(F.lit("bad number: "), line)).when(F.col("_id").isNull(), F.concat(F.lit("missing ID: "), line))
    read = F.struct(F.col("_seqid").alias("seqid"), F.greatest(F.least(s, e) - 1, F.lit(0)).alias("s0"), F.greatest(s, e).alias("e0"), F.col("_id").alias("id"), indexed_value(line, "Parent", f";{SPACE}").alias("parent"), indexed_value(line, attribute, ";").alias("attr"), fault.alias("fault"))
    return rows.select(*names, F.when(line.isNotNull(), read).alias("feature"))


def feature_rows(lines: DataFrame, attribute: str = ATTRIBUTE, skip_types: str = SKIPPED) -> DataFrame:
    """Lines as features: part, off and the columns of ``with_features``."""
    return with_features(lines.select("part", "off", "line"), attribute, skip_types).filter("feature IS NOT NULL").select("part", "off", "feature.*")


def placed_within_parts(rows: DataFrame) -> DataFrame:
    """Adds to lines with features what can be found within their part: fid, par, b0 and ``block`` (the block's fid), as ``linked`` and ``block_placed`` have them.

    Rows are dealt by part once. A feature asks the last feature in its part that has its parent's id; ids are names of groups,
    and lines that have none a group each. It is the whole index where ``parts_stand_alone``.
    """
    alone = F.concat(F.lit("\n"), F.col("off").cast("string"))  # no id holds a line feed
    told, asked = F.struct(F.coalesce("feature.id", alone).alias("key"), F.col("off").alias("told")), F.struct(F.coalesce("feature.parent", alone).alias("key"), F.lit(None).cast("long").alias("told"))
    rows = rows.withColumn("_own", F.coalesce("feature.id", alone)).withColumn("_r", F.explode(F.array(told, asked))).select("*", "_r.key", "_r.told")
    rows = rows.withColumn("_par", F.max("told").over(W.partitionBy("part", "key"))).filter("told IS NULL").drop("_r", "key", "told")
    of_id = W.partitionBy("part", "_own")
    rows = rows.withColumn("fid", F.when(F.col("feature").isNotNull(), F.max("off").over(of_id)))
    # the alone rows ask for nothing, and those without a known parent are their own
    rows = rows.withColumn("par", F.when(F.col("fid").isNotNull(), F.coalesce("_par", "fid"))).withColumn("_root", F.coalesce(F.col("par") == F.col("fid"), F.lit(False)))
    rows = rows.withColumn("_last", F.max(F.when(F.col("_root"), F.col("off"))).over(of_id))
    begins = F.when(F.col("_root"), F.struct(F.col("off").alias("b0"), F.when(F.col("off") == F.col("_last"), F.col("fid")).alias("block")))
    rows = rows.withColumn("_b", F.last(begins, ignorenulls=True).over(W.partitionBy("part").orderBy("off")))
    return rows.select("*", "_b.b0", "_b.block").drop("_own", "_par", "_root", "_last", "_b")


def parts_stand_alone(rows: DataFrame) -> bool:
    """Whether no id or parent's id of a part is an id of another, and no line's block begins in an earlier part.

    Hashes of ids are compared, not ids: equal ones of different ids could only make this false.
    """
    ends = rows.agg(F.min("b0").alias("first"), F.max(F.when(F.col("b0").isNull(), F.col("off"))).alias("without")).first()
    if ends.first is not None and ends.without is not None and ends.without > ends.first:
        return False
    features = rows.filter("feature IS NOT NULL")
    name = lambda df, key, asks: df.select(F.xxhash64(key).alias("h"), "part", F.lit(asks).alias("asks"))
    names = name(features, "feature.id", False).unionByName(name(features.filter("par = fid AND feature.parent IS NOT NULL"), "feature.parent", True))
    return names.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("asks").alias("asks")).filter("a <> b AND NOT asks").isEmpty()


def linked(features: DataFrame) -> DataFrame:
    """Adds fid (the last feature with the id) and par (the parent id's fid; without a known parent the own one)."""
    numbered = features.withColumn("fid", F.max("off").over(W.partitionBy("id")))
    known = numbered.select(F.col("id").alias("parent"), F.col("fid").alias("pfid")).distinct()
    return numbered.join(known, "parent", "left").select(*features.columns, "fid", F.coalesce("pfid", "fid").alias("par"))


def root_spans(links: DataFrame) -> DataFrame:
    """Features that are their own parent: part, b0 (where the block begins), fid, seqid, s0, e0. An id may have several."""
    return links.filter("par = fid").select("part", F.col("off").alias("b0"), "fid", "seqid", "s0", "e0")


def carried(parts: DataFrame, value: str, forward: bool) -> DataFrame:
    """Over a table of one row per part: the last value of earlier parts, or the first of later ones."""
    order = W.orderBy("part") if forward else W.orderBy(F.desc("part"))
    return parts.select("part", F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("carry"))


def placed_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds b0, the offset of the last root line at or before each line; null before the first root.

    Blocks are stretches of text whatever the lines in them say. The running value is taken within each part and carried
    over between parts, of which there are few.
    """
    marked = lines.join(spans.select(F.col("b0").alias("off"), F.lit(True).alias("root")), "off", "left").withColumn("at", F.when(F.col("root"), F.col("off")))
    within = marked.withColumn("b0", F.last("at", ignorenulls=True).over(W.partitionBy("part").orderBy("off")))
    parts = carried(lines.select("part").distinct().join(spans.groupBy("part").agg(F.max("b0").alias("last")), "part", "left"), "last", True)
    return within.join(F.broadcast(parts.withColumnRenamed("part", "_part")), F.col("part") == F.col("_part")).select(*lines.columns, F.coalesce("b0", "carry").alias("b0"))


def block_placed(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds b0 and the block's fid. A root's number leads to its last block alone; fid is null in the others."""
    reachable = spans.groupBy("fid").agg(F.max("b0").alias("b0"))
    return placed_lines(lines, spans).join(reachable, "b0", "left")


def block_extents(spans: DataFrame, end_of_file: DataFrame) -> DataFrame:
    """fid, seqid, b0 and b1 of every block: it ends where the next root's line begins, the last one at the end of the file (column ``end``)."""
    nexts = F.lead("b0").over(W.partitionBy("part").orderBy("b0"))
    carry = carried(spans.groupBy("part").agg(F.min("b0").alias("first")), "first", False).withColumnRenamed("part", "_part")
    found = spans.withColumn("next", nexts).join(F.broadcast(carry), F.col("part") == F.col("_part"))
    return found.crossJoin(F.broadcast(end_of_file.select("end").limit(1))).select("fid", "seqid", "b0", F.coalesce("next", "carry", "end").alias("b1"))


@dataclass
class Annotation:
    """Tables of one annotation. ``attribute`` is the key whose values ``attr`` holds.

    ``lines``: b0, part, off, line, eol, data, bad, seqid, type, s1, e1, attrs, id, fid. ``links``: part, off, seqid, s0, e0, id, parent, attr, fid, par.
    """

    lines: DataFrame
    links: DataFrame
    attribute: str = ATTRIBUTE
    end: DataFrame | None = None
    stored_roots: DataFrame | None = None
    unplaced: DataFrame | None = None
    read: DataFrame | None = None

    @cached_property
    def spans(self) -> DataFrame:
        return root_spans(self.links)

    @property
    def block_lines(self) -> DataFrame:
        """Lines of reachable blocks."""
        return self.lines.filter("fid IS NOT NULL")

    @cached_property
    def seqids(self) -> DataFrame:
        """Sequences that have a root."""
        return self.spans.select("seqid").distinct()

    @cached_property
    def roots(self) -> DataFrame:
        """(node, root): the root each feature's chain of parents ends in, null on cycles."""
        return self.stored_roots if self.stored_roots is not None else resolve_roots(self.links.select(F.col("off").alias("node"), F.col("par").alias("parent")))

    @cached_property
    def blocks(self) -> DataFrame:
        end = self.end if self.end is not None else self.lines.agg(F.max(F.col("off") + F.octet_length("line") + F.length("eol")).alias("end"))
        return block_extents(self.spans, end)

    def save(self, path: str) -> Annotation:
        """Writes Parquet tables and returns the annotation that reads them. Each table is made from those written before it.

        Where the parts of a text stand alone, lines and links are one table, ``rows``, made in one go.
        """
        spark = self.lines.sparkSession
        together = False
        if self.read is not None:
            rows = placed_within_parts(self.read.withColumn("feature", F.col("feature").dropFields("fault")))
            rows.drop("attrs").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
            together = parts_stand_alone(spark.read.parquet(f"{path}/rows"))
        if together:
            links = _links_of(spark.read.parquet(f"{path}/rows"))
            near = near_roots(links.select(F.col("off").alias("node"), F.col("par").alias("parent")))
            near.write.mode("overwrite").parquet(f"{path}/roots")
            near = spark.read.parquet(f"{path}/roots")
            if not near.filter("root IS NULL").isEmpty():
                far_roots(cut(near)).write.mode("overwrite").parquet(f"{path}/roots")
            self._save_about(path, True)
            return Annotation.load(spark, path)
        self.links.write.mode("overwrite").parquet(f"{path}/links")
        links = spark.read.parquet(f"{path}/links")
        resolve_roots(links.select(F.col("off").alias("node"), F.col("par").alias("parent"))).write.mode("overwrite").parquet(f"{path}/roots")
        unplaced = self.lines if self.unplaced is None else self.unplaced
        lines = block_placed(unplaced, root_spans(links)) if self.unplaced is not None else unplaced
        lines.write.mode("overwrite").parquet(f"{path}/lines")
        self._save_about(path, False)
        return Annotation.load(spark, path)

    def _save_about(self, path: str, together: bool) -> None:
        about = self.lines.sparkSession.createDataFrame([(self.attribute, together)], "attribute string, together boolean")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Annotation:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        about = read("about").first().asDict()
        if about.get("together"):
            lines, links = _lines_of(read("rows")), _links_of(read("rows"))
        else:
            lines, links = read("lines"), read("links")
        return cls(lines, links, about["attribute"], stored_roots=read("roots").select("node", "root"))


def _links_of(rows: DataFrame) -> DataFrame:
    return rows.filter("fid IS NOT NULL").select("part", "off", "feature.*", "fid", "par")


def _lines_of(rows: DataFrame) -> DataFrame:
    """Lines of a table of rows; what stands behind the eighth tab is taken from the text again."""
    names = [c for c in rows.columns if c not in ("feature", "fid", "par", "block")]
    attrs = F.when(F.col("data"), F.get(F.split("line", "\t", 9), F.lit(8))).alias("attrs")
    return rows.select(*names, attrs, F.col("block").alias("fid"))


TABLES = ("lines", "links", "roots", "about")


def missing_tables(spark: SparkSession, path: str) -> list[str]:
    """Which tables of a saved annotation aren't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda t: (p := hadoop(f"{path}/{t}/_SUCCESS")).getFileSystem(conf).exists(p)
    return [t for t in TABLES if not (there(t) or (t in ("lines", "links") and there("rows") and there("about")))]


def from_lines(lines: DataFrame, attribute: str = ATTRIBUTE, skip_types: str = SKIPPED, check: bool = True) -> Annotation:
    """An annotation from (part, off, line, eol). The first line that can't be read is an error, unless ``check`` is off."""
    features = feature_rows(lines, attribute, skip_types)
    if check:
        odd = F.count(F.when(F.col("attr").rlike("[ ,]"), 1)).alias("odd")
        seen = features.agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("off"))).alias("fault"), odd).first()
        if seen.fault:
            raise BadAnnotation(seen.fault)
        if seen.odd:
            warnings.warn(f"{seen.odd} values of {attribute} hold blanks or commas, which should be written as %20 and %2C", stacklevel=3)
    links = linked(features.drop("fault"))
    read = with_features(with_columns_of_lines(lines), attribute, skip_types)
    lines = with_columns_of_lines(lines)
    return Annotation(block_placed(lines, root_spans(links)), links, attribute, unplaced=lines, read=read)


def build_index(spark: SparkSession, path: str, attribute: str = ATTRIBUTE, skip_types: str = SKIPPED, save: str | None = None) -> Annotation:
    """Reads a GFF3 file. With ``save`` the tables are written there and read again, which any number of queries can share."""
    found = from_lines(read_lines(spark, path), attribute, skip_types)
    return found if save is None else found.save(save)
