"""Interval joins by bins of several widths, and lengths of unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Widths of bins are powers of two; a span belongs to the narrowest of which four are as long as it, so it touches five bins at most.
#: Spans of nearly the same length are of one level by this, mostly, and are sent once.
LEVELS = (9, 12, 15, 18, 21, 24, 27, 30, 33)


def level_of(low: Column, high: Column) -> Column:
    """The level of the closed span low..high."""
    out = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(high - low < (4 << level), level).otherwise(out)
    return out


def levels_in(*sides: DataFrame) -> list[list[int]]:
    """The levels that occur among each side's ``_low`` and ``_high``: nine at most, found in one job."""
    each = [df.select(F.lit(i).alias("side"), level_of(F.col("_low"), F.col("_high")).alias("level")).distinct() for i, df in enumerate(sides)]
    rows = reduce(DataFrame.unionByName, each).collect()
    return [sorted(r.level for r in rows if r.side == i) for i in range(len(sides))]


def _ends(df: DataFrame, start: str, end: str) -> DataFrame:
    """Adds the closed hull ``_low``.. ``_high`` of a half-open span, which may be empty or reversed."""
    return df.withColumn("_low", F.least(F.col(start), F.col(end) - 1)).withColumn("_high", F.greatest(F.col(start), F.col(end) - 1))


def _binned(df: DataFrame, levels: Column) -> DataFrame:
    """A row for each bin that the span touches at each of the levels: ``_level``, ``_bin``."""
    df = df.withColumn("_level", F.explode(levels))
    shift = lambda c: F.expr(f"shiftright({c}, _level)")
    return df.withColumn("_bin", F.explode(F.sequence(shift("_low"), shift("_high"))))


def _sides(left: DataFrame, right: DataFrame, among: DataFrame | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Two pairs of binned tables. Each pair of spans meets at the wider one's level: first those where the left is as wide or wider, then the others.

    The levels of the left are looked for in ``among``, if given: a table with its bounds among others that is cheaper to read.
    """
    own = F.array(level_of(F.col("_low"), F.col("_high")))
    lefts, rights = levels_in(left if among is None else among, right)
    above = lambda levels, strictly: F.filter(F.array(*map(F.lit, levels)), lambda x: (x > own[0]) if strictly else (x >= own[0]))
    out = []
    if lefts and rights:
        out.append((_binned(left, own), _binned(right, above(lefts, False))))
        if any(r > lefts[0] for r in rights):
            out.append((_binned(left, above(rights, True)), _binned(right, own)))
    return out


#: Up to so many rows a side is sent to every task instead; beyond it both sides are binned.
FEW = 64


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str = "s0", end: str = "e0", q_start: str = "qs", q_end: str = "qe") -> DataFrame:
    """Pairs of rows with equal ``key`` where start < q_end and end > q_start, each once, with the columns of both sides.

    An equi join on key, level and bin. A pair is counted in the bin where the later of the two begins. As a span is
    widened to five bins at most, long spans aren't exploded, and a key that a third of the rows have is still spread
    by its bins. A right side of a few rows is broadcast instead. Other columns of the two sides have to differ in name.
    """
    if _few(right):
        return left.join(F.broadcast(right), key).filter((F.col(start) < F.col(q_end)) & (F.col(end) > F.col(q_start)))
    left, right = _ends(left, start, end), _ends(right, q_start, q_end)
    names = [c for c in left.columns if c not in ("_low", "_high")] + [c for c in right.columns if c not in (key, "_low", "_high")]
    right = right.withColumnsRenamed({"_low": "_qlow", "_high": "_qhigh"})
    out = None
    for a, b in _sides(left, right.withColumnsRenamed({"_qlow": "_low", "_qhigh": "_high"})):
        b = b.withColumnRenamed("_low", "_qlow").drop("_high")
        meet = a.drop("_high").join(b, [key, "_level", "_bin"])
        here = F.col("_bin") == F.expr("shiftright(greatest(_low, _qlow), _level)")
        part = meet.filter(here & (F.col(start) < F.col(q_end)) & (F.col(end) > F.col(q_start))).select(*names)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = left.join(right, key).filter(F.lit(False)).select(*names)
    return out


def touching(left: DataFrame, right: DataFrame, key: str, test: Column, row: str, start: str = "s1", end: str = "e1", q_start: str = "qs", q_end: str = "qe", among: DataFrame | None = None) -> DataFrame:
    """Rows of ``left`` for which some row of ``right`` with the same key passes ``test``: a semi join, each row once by ``row``.

    ``test`` may only pass where the closed hulls of the spans meet; bounds are closed here and may be reversed.
    ``among`` may be a table that has all bounds of ``left``, others too, and is cheaper to read.
    """
    if _few(right):
        few = right.select(F.col(key).alias("_key"), q_start, q_end)
        return left.join(F.broadcast(few), (F.col(key) == F.col("_key")) & test, "left_semi")
    hull = lambda df, a, b: df.withColumn("_low", F.least(a, b)).withColumn("_high", F.greatest(a, b))
    left, right = hull(left, start, end), hull(right, q_start, q_end)
    among = None if among is None else hull(among, start, end)
    names, out = [c for c in left.columns if c not in ("_low", "_high")], None
    for a, b in _sides(left, right, among):
        b = b.select(F.col(key).alias("_key"), F.col("_level").alias("_qlevel"), F.col("_bin").alias("_qbin"), q_start, q_end)
        part = a.join(b, (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_qlevel")) & (F.col("_bin") == F.col("_qbin")) & test, "left_semi").select(*names)
        out = part if out is None else out.unionByName(part)
    return left.select(*names).filter(F.lit(False)) if out is None else out.dropDuplicates([row])


def covering_point(spans: DataFrame, key: str, at_key: str, point: int) -> DataFrame:
    """Spans of a key that hold a point, both ends included."""
    return spans.filter((F.col(key) == at_key) & (F.col("s0") <= point) & (F.col("e0") >= point))


def union_length(pieces: DataFrame, by: list[str], start: str = "a", end: str = "b", out: str = "length", shift: int = 20) -> DataFrame:
    """How many positions the half-open pieces of each group cover.

    Pieces are parted at multiples of 2^20 first; the lengths of the parts add up, so that a group with very many pieces
    is spread over many tasks. Within a part each piece adds what lies beyond all that began before it.
    """
    shifted = lambda c: F.expr(f"shiftright({c}, {shift})")
    pieces = pieces.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(shifted(start), shifted(f"{end} - 1"))))
    low, high = F.greatest(F.col(start), F.shiftleft("_bin", shift)), F.least(F.col(end), F.shiftleft(F.col("_bin") + 1, shift))
    pieces = pieces.select(*by, "_bin", low.alias("_a"), high.alias("_b")).distinct()
    before = F.max("_b").over(W.partitionBy(*by, "_bin").orderBy("_a", "_b").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.col("_b") - F.greatest(F.col("_a"), F.coalesce(before, F.col("_a"))), F.lit(0))
    return pieces.withColumn("_added", added).groupBy(*by).agg(F.sum("_added").alias(out))


def merged(pieces: DataFrame, by: list[str], start: str = "a", end: str = "b", shift: int = 20) -> DataFrame:
    """The half-open pieces of each group joined where they overlap or touch; an empty one is a piece too, a reversed one isn't.

    Pieces are parted at multiples of 2^20 and joined within each part, so that a group with very many pieces is spread.
    What touches neither end of its part is done; of the rest each part has two at most, which are joined anew.
    """
    shifted = lambda c: F.expr(f"shiftright({c}, {shift})")
    parts = pieces.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(shifted(start), shifted(f"greatest({start}, {end} - 1)"))))
    first, after = F.shiftleft(F.col("_bin"), shift), F.shiftleft(F.col("_bin") + 1, shift)
    parts = parts.select(*by, "_bin", F.greatest(F.col(start), first).alias(start), F.least(F.col(end), after).alias(end))
    joined = _joined(parts, [*by, "_bin"], start, end).withColumn("_open", (F.col(start) == first) | (F.col(end) == after))
    return joined.filter("NOT _open").select(*by, start, end).unionByName(_joined(joined.filter("_open").select(*by, start, end), by, start, end))


def _joined(pieces: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = pieces.withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
