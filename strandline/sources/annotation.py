"""GFF3 text as a table of lines with their byte offsets, and lines back to text."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.functions.fields import first_value, once, u32


def with_columns_of_lines(lines: DataFrame) -> DataFrame:
    """Adds what the scans of blocks need to (off, line): seqid, type, s1, e1, attrs, id, ``data`` (not empty, no comment) and ``bad`` (not UTF-8).

    Columns are split at tabs, the ninth holds the rest; what isn't there or isn't a number is null.
    """
    names = lines.columns
    lines = lines.select("*", ((F.length("line") > 0) & ~F.startswith("line", F.lit("#"))).alias("data"), (~F.is_valid_utf8("line")).alias("bad"), once(F.split("line", "\t", 9)).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    held = lambda c: F.when(F.col("data"), c)
    lines = lines.select(*names, "data", "bad", held(at(0)).alias("seqid"), held(at(2)).alias("type"), held(u32(at(3))).alias("s1"), held(u32(at(4))).alias("e1"), held(at(8)).alias("attrs"))
    return lines.withColumn("id", first_value(F.col("attrs"), "ID", "; \\t"))


class SeveralFiles(ValueError):
    """The path has more than one file: their order, and what offsets count from, isn't defined."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of one file; several are an error. Columns: part, off (bytes before it), line (without its newline) and ``eol`` (its newline, empty at an open end).

    Offsets come from a two-level sum: within the file's splits, whose lines are in order, and over the splits, of which
    there are few. ``part`` rises with ``off``.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    if len(files := text.inputFiles()) > 1:
        raise SeveralFiles(f"an annotation is one file, {path} has {len(files)}")
    raw = text.select(
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row")
    )
    raw = raw.withColumn("bytes", F.octet_length("line") + 1)
    totals = raw.groupBy("block").agg(F.sum("bytes").alias("bytes"))
    before = totals.select(F.col("block").alias("b"), (F.sum("bytes").over(W.orderBy("block")) - F.col("bytes")).alias("before"))
    within = F.sum("bytes").over(W.partitionBy("block").orderBy("row")) - F.col("bytes")
    placed = raw.withColumn("within", within).join(F.broadcast(before), F.col("block") == F.col("b"))
    off = F.col("before") + F.col("within")
    return placed.select(F.col("block").alias("part"), off.alias("off"), "line", F.when(off + F.octet_length("line") < F.col("size"), "\n").otherwise("").alias("eol"))


def in_order(lines: DataFrame) -> DataFrame:
    return lines.select("off", "line", "eol").orderBy("off")


def write_lines(lines: DataFrame, path: str | None = None) -> int:
    """Lines in file order, byte for byte, to a local file or standard output; how many. Rows pass through the driver one partition at a time."""
    n, out = 0, Path(path).open("wb") if path else sys.stdout.buffer
    rows = in_order(lines).select(F.concat(F.col("line").cast("binary"), F.col("eol").cast("binary")).alias("bytes"))
    try:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            out.write(row.bytes)
            n += 1
        out.flush()
    finally:
        if path:
            out.close()
    return n


def save_lines(lines: DataFrame, path: str) -> None:
    """The same as part files of a folder, whose order is that of their names."""
    in_order(lines).select("line").write.text(path, lineSep="\n")


def write_table(df: DataFrame, path: str | None, fraction: str | None = None) -> None:
    """Tab-separated with a header, by id; the column ``fraction`` to six places."""
    out = Path(path).open("w", encoding="utf-8") if path else sys.stdout
    try:
        out.write("\t".join(df.columns) + "\n")
        for row in df.orderBy("id").toLocalIterator(prefetchPartitions=True):
            out.write("\t".join(f"{v:.6f}" if c == fraction else str(v) for c, v in zip(df.columns, row)) + "\n")
        out.flush()
    finally:
        if path:
            out.close()


def save_table(df: DataFrame, path: str, fraction: str | None = None) -> None:
    # ties go to the even digit, as write_table has it; the JVM's format alone rounds them up
    cells: list[Column] = [F.format_string("%.6f", F.bround(F.col(c), 6)).alias(c) if c == fraction else F.col(c) for c in df.columns]
    df.select(*cells).orderBy("id").write.option("sep", "\t").option("header", True).csv(path)
