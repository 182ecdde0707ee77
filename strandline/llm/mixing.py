"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.llm.support import cut, running_totals, table, WORD

#: The golden ratio's fraction, whose multiples modulo one fill the unit interval evenly; slots are taken apart at 2^26, so
#: that products in doubles keep their fractions however many slots there are.
_EXACT = (Fraction(isqrt(5 * 10**80), 10**40) - 1) / 2
SPLIT = 1 << 26
GOLDEN, GOLDEN_SPLIT = float(_EXACT), float(_EXACT * SPLIT % 1)
#: Up to so many sources their table is sent to every task.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """``documents``: one row per input row. ``slots``: the schedule, a row per slot: slot, s (source number), rank, block, words."""

    documents: DataFrame
    slots: DataFrame


def one_two_three(number: Column) -> Column:
    """The weight of a source by its place in the order of sources."""
    return 1 + number % 3


def measure(docs: DataFrame, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """``row`` (the columns ``keep`` as a struct, so that names can't clash), ``source``, ``size`` in words, and the shuffle hashes ``h1``, ``h2``."""
    columns = docs.columns if keep is None else keep
    return docs.select(
        (F.struct(*[docs[c] for c in columns]) if columns else F.lit(0)).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *shuffle_hashes(id_col, text_col, seed),
    )


def shuffle_hashes(id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h1"), F.xxhash64(F.lit(seed + 1), text, F.col(id_col)).alias("h2")


def _sources(measured: DataFrame) -> DataFrame:
    """s (number in the order of code points, null last), source, source_size, n. Sorted over all tasks, as there may be many."""
    found = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = cut(found.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("of"))  # a row for each task
    parts = parts.select("part", (F.sum("of").over(W.orderBy("part")) - F.col("of")).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return placed.join(F.broadcast(parts), "part").select(number.cast("long").alias("s"), "source", "source_size", "n")


def with_targets(sources: DataFrame, weights: Callable[[Column], Column], cap: float) -> DataFrame:
    """Adds ``target``: shares of all words by weight, none above ``cap`` times its size; what is cut off is shared again by weight.

    Each turn holds those at their cap that would get more, and shares the rest among the others; few turns are needed.
    """
    sources = sources.withColumn("weight", weights(F.col("s")).cast("double"))
    size, weight = F.col("source_size"), F.col("weight")
    first = sources.agg(F.sum("source_size").alias("total"), F.sum(F.when(size > 0, weight)).alias("open")).first()
    total, left, open_, held = float(first.total or 0), float(first.total or 0), first.open or 0.0, 0
    while open_:
        share = F.lit(left) * weight / F.lit(open_)
        full = (size > 0) & (share > cap * size)
        now = sources.agg(F.count(F.when(full, 1)).alias("held"), F.sum(F.when(full, cap * size)).alias("given"), F.sum(F.when((size > 0) & ~full, weight)).alias("open")).first()
        if now.held == held or not now.open:
            break
        held, left, open_ = now.held, total - now.given, now.open
    target = F.least(F.lit(left) * weight / F.lit(open_), cap * size) if open_ else F.lit(0.0)
    return sources.withColumn("target", F.when(size > 0, target).otherwise(0.0)).drop("weight")


def mix(measured: DataFrame, weights: Callable[[Column], Column] = one_two_three, block_words: int = 1024, cap: float = 3.0) -> Mix:
    """Take words from each source up to its target, as many in all as there are. ``measured`` comes from ``measure``.

    A source's documents, shuffled by a seeded hash of their content, form one stream of words that is cut into blocks
    of ``block_words``; a document may lie in several blocks. Slot i of the schedule draws the point ``frac(i * golden)``;
    the interval of cumulative target shares that holds it names the source. The rank of a slot within its source
    chooses the block (rank modulo the number of blocks: a source that is over-sampled is walked again in the same
    order). Slots past the target go, the last one is cut to the words that are left, and sources to which the points
    gave too few slots get the missing ones at the end; so each source gives exactly its target, rounded down to a word.

    Running sums are taken in blocks, over buckets of the shuffle hash and over parts of the schedule whose numbers grow
    with the documents, so a source that holds a third of all rows is spread over many tasks. The table of sources stays
    in Spark too; it is sent to all tasks only while it is small.

    ``documents`` has ``row``, ``source``, ``h1``, ``h2``, ``size``, ``source_size``, ``target``, ``taken`` and
    ``first_slot`` (null if none). A null source is a source of its own, the last in order; null or empty text has size 0 and is
    never taken. Rows that repeat are separate documents with neighbouring places in the shuffle. With ``cap`` a whole
    number no document is taken more than ``cap`` times its size. Empty tables give an empty result.
    """
    plan = with_targets(_sources(measured), weights, cap)
    size, quota = F.col("source_size"), F.least(F.floor(F.col("target") + 1e-6), F.floor(cap * F.col("source_size"))).cast("long")
    per_pass = F.when(size > 0, F.col("quota") % size).otherwise(0)
    plan = plan.withColumn("quota", quota).withColumn("blocks", F.ceil(size / block_words)).withColumn("passes", F.when(size > 0, F.floor(F.col("quota") / size)).otherwise(0))
    plan = plan.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(per_pass / block_words)).drop("passes")
    plan = cut(running_totals(plan, [], "s", "quota", "low"))
    whole = plan.agg(F.count(F.lit(1)).alias("sources"), F.sum("source_size").alias("words"), F.sum("quota").alias("quota"), F.sum("n").alias("n")).first()
    n_sources, total, quotas, rows = whole.sources, whole.words or 0, whole.quota or 0, whole.n or 0
    small = F.broadcast if n_sources <= FEW_SOURCES else lambda df: df
    n_slots, buckets = -(-total // block_words), max(64, rows // 2_000)

    names = plan.select("s", F.col("source").alias("name"))
    placed = measured.join(small(names), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    sums = running_totals(placed.groupBy("s", "bucket").agg(F.sum("size").alias("words")), ["s"], "bucket", "words", "before").drop("words")
    within = W.partitionBy("s", "bucket").orderBy("h1", "h2", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["s", "bucket"]).select("s", "row", "source", "h1", "h2", "size", (F.col("before") + F.col("at")).alias("at"))

    slots = _schedule(plan, small, n_slots, n_sources, quotas, block_words)
    # the stretch of each block that a document fills, against how often and how far the schedule takes the block
    used = slots.groupBy("s", "block", "words").agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    last = F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.filter("size > 0").select("s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block_words), last)).alias("block"))
    into = F.col("at") - F.col("block") * block_words
    words = F.greatest(F.least(into + F.col("size"), F.col("words")) - F.greatest(into, F.lit(0)), F.lit(0))
    taken = pieces.join(used, ["s", "block"]).withColumn("of", words).groupBy("s", "at").agg(F.sum(F.col("of") * F.col("times")).alias("taken"), F.min(F.when(F.col("of") > 0, F.col("slot"))).alias("first_slot"))
    # documents of some size have places of their own, so the place names the document
    taken = taken.withColumn("some", F.lit(True))
    documents = placed.withColumn("some", F.col("size") > 0).join(taken, ["s", "at", "some"], "left").join(small(plan.select("s", "source_size", "target")), "s")
    return Mix(documents.select("row", "source", "h1", "h2", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"), slots)


def _schedule(plan: DataFrame, small: Callable[[DataFrame], DataFrame], n_slots: int, n_sources: int, quotas: int, block_words: int, part_slots: int = 4096) -> DataFrame:
    """Slots with their source, rank, block and number of words."""
    spark, grid = plan.sparkSession, max(4096, n_sources)
    live, width = plan.filter("quota > 0").withColumn("high", F.col("low") + F.col("quota")), max(quotas, 1) / grid
    # the cells of a grid turn the interval join into an equi join
    cell = lambda x: F.floor(x / F.lit(width))
    cells = live.select("s", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    slot = F.col("slot")
    point = ((slot % SPLIT) * F.lit(GOLDEN) % 1.0 + F.floor(slot / SPLIT) * F.lit(GOLDEN_SPLIT) % 1.0) % 1.0
    drawn = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point * F.lit(float(quotas))).withColumn("cell", cell(F.col("point")))
    drawn = drawn.join(small(cells), "cell").filter("point >= low AND point < high").select("slot", "s", F.floor(slot / part_slots).alias("part"))
    counts = running_totals(drawn.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n")), ["s"], "part", "n", "before")
    rank = F.col("before") + F.row_number().over(W.partitionBy("s", "part").orderBy("slot")) - 1
    ranked = drawn.join(counts, ["s", "part"]).select("slot", "s", rank.alias("rank"))
    had = counts.groupBy("s").agg(F.sum("n").alias("had"))
    late = live.join(had, "s", "left").select("s", F.coalesce("had", F.lit(0)).alias("had"), "need").filter("need > had")
    late = late.select("s", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank")).select((F.col("rank") * n_sources + F.col("s") + n_slots).alias("slot"), "s", "rank")
    every = ranked.unionByName(late).join(small(live.select("s", "source_size", "quota", "blocks", "need")), "s").filter("rank < need")
    block, turn = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    begin = F.col("source_size") * turn + block * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - block * block_words, F.col("quota") - begin)
    return every.select("slot", "s", "rank", block.alias("block"), words.cast("long").alias("words"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, to the nearest whole; in each partition in the order of the schedule.

    Only hashes and sizes go through the mix; texts are exchanged once, when it is done. Rows that share id, text and
    source are taken as often as all of them are, in turn. Null and empty texts are never taken; an empty table stays empty.
    """
    found = mix(cut(measure(docs, [], id_col, text_col, source_col)), **options).documents
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)
    key = ["h1", "h2"]
    found = cut(found.groupBy(*key, "source").agg(F.sum(times).alias("times"), F.count(F.lit(1)).alias("n"), F.min("first_slot").alias("slot")).filter("times > 0"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("of"), *shuffle_hashes(id_col, text_col))
    both = rows.join(found, key).filter(F.col("of").eqNullSafe(F.col("source")))
    turn = F.row_number().over(W.partitionBy(*key).orderBy("source"))
    share = F.floor(turn * F.col("times") / F.col("n")) - F.floor((turn - 1) * F.col("times") / F.col("n"))
    both = both.withColumn("share", F.when(F.col("n") == 1, F.col("times")).otherwise(share)).filter("share > 0")
    both = both.select("row", "slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))).alias("time"))
    return both.sortWithinPartitions("slot", "time").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(cut(measure(docs, ["doc_id"]))).documents.select("row.doc_id", "size", "source_size", "target", "taken")
