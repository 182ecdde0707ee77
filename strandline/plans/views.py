"""Orders and their items as an annotation, events as regions: the shape in which the registered queries run.

An order is a gene, each of its items a child of the gene or, on even line numbers, of the item before it. Items share line
numbers and skip some, which gives repeated ids and unknown parents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.plans.model import Annotation, from_lines
from strandline.session import shared_folder


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, off, line, eol. Orders are far apart, so offsets are the order's key times 1000 and the place within it.

    Orders and items are dealt by part, once and without text; an item takes its orders from its key's group, and lines are written after that.
    """
    k, ln = F.col("k"), F.col("ln")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), zero.cast("int").alias("ln"), zero.alias("pk"), zero.alias("sk"), zero.alias("q"), none.cast("string").alias("flag"), F.struct("o_custkey", "o_orderpriority").alias("own"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("long").alias("q"), F.coalesce("l_returnflag", F.lit("")).alias("flag"), none.cast(orders.schema["own"].dataType).alias("own"))
    rows = orders.unionByName(items).withColumn("part", F.floor(k / 4096)).repartition("part")
    rows = rows.withColumn("orders", F.collect_list("own").over(W.partitionBy("part", "k")))
    rows = rows.withColumn("order", F.explode(F.when(F.col("flag").isNull(), F.array("own")).otherwise(F.col("orders")))).select("part", "k", "ln", "pk", "sk", "q", "flag", "order.o_custkey", "order.o_orderpriority")
    kind = F.when(F.col("flag").isNull(), "gene").when(F.col("flag") == "A", "exon").when(F.col("flag") == "N", "CDS").otherwise("mRNA")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("part", "k").orderBy("ln", "pk", "sk", "q", "kind")) - 1)
    gene, start = F.col("flag").isNull(), k * 100 + 1
    end = F.when(gene, k * 100 + 50 + (k * 37) % 400)
    start = F.when(gene, start).otherwise(start + F.col("pk") % 50)
    parent = F.when(ln % 2 == 0, F.concat(F.lit("x"), k, F.lit("."), ln - 1)).otherwise(F.concat(F.lit("g"), k))
    attrs = F.when(gene, F.concat(F.lit("ID=g"), k, F.lit(";gene_name="), F.col("o_orderpriority"), F.lit("_"), F.col("o_custkey") % 50)).otherwise(F.concat(F.lit("ID=x"), k, F.lit("."), ln, F.lit(";Parent="), parent))
    seqid = F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string"))
    line = F.concat_ws("\t", seqid, F.lit("src"), F.col("kind"), start.cast("string"), F.coalesce(end, start + F.col("q")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    return rows.select("part", (k * 1000 + F.col("place")).alias("off"), line.alias("line"), F.lit("\n").alias("eol"))


_INDEXED: dict[tuple[str, str], str] = {}


def annotation(spark: SparkSession, sf_dir: str) -> Annotation:
    """The index of a folder's annotation: built by the first query of an application, read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        from_lines(annotation_lines(spark, sf_dir), check=False).save(path)
        _INDEXED[key] = path
    return Annotation.load(spark, _INDEXED[key])


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but errors, which stand for unmapped reads: rid, seqid, qs, qe."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'error'")
    start = F.col("event_id") * 150
    return events.select(F.col("event_id").alias("rid"), F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")).alias("seqid"), start.alias("qs"), (start + 1 + F.floor("value")).alias("qe"))
