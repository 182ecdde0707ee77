"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import gc
import re
import uuid
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.session import cut, importable, shared_folder

__all__ = ["cut"]

#: ASCII white space: the only characters that separate words here.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Of the map that tells which rows of a table may be wanted.
MAP_BITS = 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session hands Python batches of 4 MB at most, so that long texts don't pile up in a worker."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    conf = importable(df.sparkSession).conf
    if int(re.sub(r"\D", "", conf.get(key)) or 0) > most or not conf.get(key).rstrip("bB").isdigit():
        conf.set(key, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row by content: equal for rows that repeat, distinct (128 bits of hash) otherwise."""
    return F.struct(
        doc_id.alias("id"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit(1), text, F.length(text)).alias("b"),
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running_totals(df: DataFrame, steps: str, out: str, block: int = 64, add: Callable[[Column, Column], Column] = lambda x, y: x + y) -> DataFrame:
    """Adds ``out``: for each element of the array ``steps`` the sum of all up to it, itself included; or their greatest, with another ``add``.

    Sums of blocks first, then within a block, so a long array costs little more than its length.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), add)
    df = df.withColumn("_sums", F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / block)), lambda b: total(F.slice(steps, (b * block + 1).cast("int"), block))))
    df = df.withColumn("_before", F.transform(F.sequence(F.lit(1), F.size("_sums")), lambda b: total(F.slice("_sums", 1, b - 1))))
    at = lambda i: add(F.get("_before", F.floor(i / block).cast("int")), total(F.slice(steps, (i - i % block + 1).cast("int"), i % block + 1)))
    # the second mention keeps the optimiser from moving the sums into the lambda
    df = df.withColumn(out, F.when(F.size("_before") > 0, F.transform(steps, lambda _, i: at(i))).otherwise(F.array().cast("array<bigint>")))
    return df.drop("_sums", "_before")


def running_totals(df: DataFrame, by: list[str], at: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows with equal ``by`` and a smaller ``at``, a whole number that is unique there.

    Sums of blocks of ``block`` values of ``at`` first, then within a block, so a key with very many rows is spread over many tasks.
    """
    df = df.withColumn("_block", F.floor(F.col(at) / block))
    blocks = df.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*by, "_block", (F.sum("_sum").over(W.partitionBy(*by).orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(W.partitionBy(*by, "_block").orderBy(at)) - F.col(value)
    df = df.withColumn("_within", within).join(blocks, [*by, "_block"])
    return df.withColumn(out, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def tidy(spark: SparkSession) -> None:
    """Removes the files of shuffles and checkpoints that no frame refers to any more, now and not when the driver's heap is full.

    Spark removes them when the driver collects its garbage, which a driver of little work seldom does. Then the driver's JVM
    gives back what its compilers have freed: the allocator keeps that, 234 MB after two runs of the pipeline.
    """
    gc.collect()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Py4JJavaError):  # not every JVM has the command
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server, of = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName
        kinds = array(jvm.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        values = array(jvm.Object, 4)
        values[0], values[1], values[2], values[3] = name, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)  # the server's own class is closed


def map_of(rows: DataFrame) -> np.ndarray:
    """A map of ``MAP_BITS`` bits, 8 MB, in which those of the rows' places are set; as many bytes at most reach the driver."""
    place = F.col("place")
    found = rows.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place % 8 + 1)).alias("bits")).toArrow()
    marks = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    marks[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return marks


def stored(df: DataFrame, name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """The same rows from a Parquet table in the shared folder, and its path; the table ``before`` goes once they are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if before:
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(path), path
