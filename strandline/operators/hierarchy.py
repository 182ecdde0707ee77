"""Roots of forests of parent links, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.session import cut


#: Numbers are parted at multiples of 2^24, and links within a part are followed there before any are joined.
NEAR = 24


def near_roots(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, root, up) for (node, parent): the root where it is 2^rounds links away at most, all of them within a part of the numbers.

    Elsewhere root is null and ``up`` is an ancestor. Numbers are dealt by part once; in each round a node asks the row of
    its ancestor for that one's ancestor. A node is known to be a root by its own link alone, so cycles have none.
    """
    part = F.shiftright("node", NEAR)
    rows = links.select(part.alias("part"), "node", F.col("parent").alias("up"), F.coalesce(F.col("node") == F.col("parent"), F.lit(False)).alias("top")).repartition("part")
    for _ in range(rounds):
        told, asked = F.struct(F.col("node").alias("key"), F.struct("up", "top").alias("told")), F.struct(F.col("up").alias("key"), F.lit(None).cast("struct<up:bigint,top:boolean>").alias("told"))
        rows = rows.withColumn("_r", F.explode(F.array(told, asked))).select("part", "node", "up", "top", "_r.key", "_r.told")
        answer = F.max("told").over(W.partitionBy("part", "key"))
        rows = rows.withColumn("answer", F.when(F.col("key").isNotNull(), answer)).filter("told IS NULL")
        rows = rows.select("part", "node", F.coalesce("answer.up", "up").alias("up"), F.coalesce("answer.top", "top").alias("top"))
    return rows.select("node", F.when(F.col("top"), F.col("up")).alias("root"), F.when(~F.col("top"), F.col("up")).alias("up"))


def far_roots(near: DataFrame) -> DataFrame:
    """(node, root) from what ``near_roots`` has left."""
    done = near.filter("root IS NOT NULL").select("node", "root")
    open_ = near.filter("root IS NULL").select("node", "up")
    n = open_.count()
    while n:
        roots = done.select(F.col("node").alias("up"), "root")
        above = open_.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        step = open_.join(roots, "up", "left").join(above, "up", "left").select("node", "root", F.coalesce("up2", "up").alias("up"))
        step = cut(step)
        done = done.unionByName(step.filter("root IS NOT NULL").select("node", "root"))
        open_ = step.filter("root IS NULL").select("node", "up")
        before, n = n, open_.count()
        if n == before:
            break
    return done.unionByName(open_.select("node", F.lit(None).cast("long").alias("root")))


def resolve_roots(links: DataFrame) -> DataFrame:
    """(node, root) for (node, parent): the end of each chain of parents, where a node is its own parent.

    What isn't found near by goes on by doubling: after round k a node knows its ancestor 2^k links up, so the rounds are the
    logarithm of the depth, and only nodes whose root isn't known yet are joined. Nodes on or above a cycle, and chains that
    leave the table, have the root null.
    """
    return far_roots(cut(near_roots(links)))
