"""Intervals and layouts of chromosomes.

Intervals are (chrom, start, end, ...), half-open.  A layout is (sample, chrom, ord, src_chrom, start, end, is_reverse): the pieces, in order, of
which a chromosome is made.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, dealt
from ..functions.columns import KEY, overlap

#: Positions of a cell of the grid on which intervals meet.
GRID = 1 << 12
#: How many times longer a cell is than one of the level below.
STEP = 8


def chrom_sizes(layout: DataFrame) -> DataFrame:
    """(sample, chrom, length), and with a null chromosome each sample's total."""
    each = layout.withColumn("length", F.col("end") - F.col("start"))
    return each.rollup("sample", "chrom").agg(F.sum("length").alias("length")).where("sample is not null")


def overlap_join(a: DataFrame, b: DataFrame, grid: int = GRID) -> DataFrame:
    """Pairs (a_id, b_id, chrom, overlap) of intervals (id, chrom, start, end) that share a position.

    Intervals have levels by their length: cells of level k are STEP ** k grids long, and an interval touches two cells of its level at
    most.  A pair meets in the cells of the higher of its two levels, so that a long interval has no more rows than a short one:
    two at its own level and two at each higher one that the other side has.  A pair is found in the first cell that both touch.
    """
    level = F.greatest(F.ceil(F.log((F.col("end") - F.col("start")) / grid) / math.log(STEP)), F.lit(0)).cast("int")

    def levelled(d: DataFrame, p: str) -> DataFrame:
        return d.where("end > start").select(F.col("id").alias(f"{p}_id"), "chrom", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), level.alias(f"{p}_level"))

    left, right = levelled(a, "a"), levelled(b, "b")
    # Levels are few: one for each STEP-fold of length.
    known = [sorted(r[0] for r in d.select(f"{p}_level").distinct().collect()) for d, p in ((left, "a"), (right, "b"))]

    def placed(d: DataFrame, p: str, levels: list[int], own: bool) -> DataFrame:
        """Rows at those of the other side's levels that are higher than their own, or not lower if `own`."""
        at = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: (k >= F.col(f"{p}_level")) if own else (k > F.col(f"{p}_level")))
        size = F.lit(grid) * F.pow(F.lit(STEP), F.col("level")).cast("long")
        return cells(d.withColumn("level", F.explode(at)), p, size)

    def cells(d: DataFrame, p: str, size) -> DataFrame:
        return d.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / size), F.floor((F.col(f"{p}_end") - 1) / size))))

    def lying(d: DataFrame, p: str) -> DataFrame:
        return cells(d.withColumn("level", F.col(f"{p}_level")), p, F.lit(grid) * F.pow(F.lit(STEP), F.col("level")).cast("long"))

    on = ["chrom", "level", "cell"]
    both = []
    if known[0] and known[1]:
        both.append(placed(left, "a", known[1], True).join(lying(right, "b"), on))
        if known[0][-1] > known[1][0]:
            both.append(lying(left, "a").join(placed(right, "b", known[0], False), on))
    rows = reduce(DataFrame.unionByName, both) if both else lying(left, "a").join(lying(right, "b"), on)
    first = F.floor(F.greatest("a_start", "b_start") / (F.lit(grid) * F.pow(F.lit(STEP), F.col("level")).cast("long")))
    shared = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return rows.where((F.col("cell") == first) & (shared > 0)).select("a_id", "b_id", "chrom", shared.alias("overlap"))


def split_intervals(intervals: DataFrame, cuts: DataFrame) -> DataFrame:
    """Intervals (id, chrom, start, end, is_reverse) cut in two at positions (id, at) counted from their start; others stay whole.

    (id, part, chrom, start, end, is_reverse); a cut outside its interval is an error.
    """
    rows = intervals.join(cuts, "id", "left").withColumn("length", F.col("end") - F.col("start"))
    checked = F.when(F.col("at") > F.col("length"), F.raise_error(F.lit("a cut lies outside its interval"))).when(F.col("at") < 0, F.raise_error(F.lit("a cut lies outside its interval"))).otherwise(F.col("at"))
    rows = rows.withColumn("at", checked.cast("long"))
    piece = lambda part, start, end: F.struct(F.lit(part).alias("part"), start.alias("s"), end.alias("e"))
    middle = F.col("start") + F.col("at")
    parts = F.when(F.col("at").isNull(), F.array(piece(0, F.col("start"), F.col("end")))).otherwise(F.array(piece(0, F.col("start"), middle), piece(1, middle, F.col("end"))))
    return rows.select("id", "chrom", "is_reverse", F.inline(parts)).select("id", "part", "chrom", F.col("s").alias("start"), F.col("e").alias("end"), "is_reverse")


def flip(intervals: DataFrame) -> DataFrame:
    """The other strand."""
    return intervals.withColumn("is_reverse", ~F.col("is_reverse"))


def merge_adjacent(intervals: DataFrame, by: tuple[str, ...] = ("chrom", "is_reverse")) -> DataFrame:
    """(by, start, end): intervals of one chromosome and strand of which one starts where the other ends as one."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    rows = intervals.withColumn("new", (~F.col("start").eqNullSafe(F.lag("end").over(w))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def boundaries(layout: DataFrame) -> DataFrame:
    """The layout with `at` and `to`: where each piece starts and ends in its chromosome."""
    w = Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end") - F.col("start")
    return layout.withColumn("to", F.sum(length).over(w)).withColumn("at", F.col("to") - length)


def locate(positions: DataFrame, layout: DataFrame) -> DataFrame:
    """(sample, chrom, coord, ord, src_chrom, src_coord, outside): the piece that holds each position (sample, chrom, coord), and its source position.

    outside is true, and the rest null, for positions beyond the chromosome.  Pieces and positions are sorted together by range, and each
    position takes the last piece that starts before it or there, from the ranges before where its own has none: as many rows as there
    are pieces and positions, however long a piece is and however many positions one chromosome has.
    """
    pieces = boundaries(layout).where("to > at")
    piece = F.struct("at", "to", "ord", "src_chrom", "start", "end", "is_reverse")
    held = positions.select(*KEY, "coord", F.struct(*positions.columns).alias("row"))
    both = pieces.select(*KEY, F.col("at").alias("coord"), piece.alias("piece")).unionByName(held, allowMissingColumns=True)
    rows = carried(dealt(both.withColumn("kind", F.col("row").isNotNull()), list(KEY), "coord", "kind"), list(KEY), last=(F.max("piece"), F.max("last")))
    before = Window.partitionBy("block", *KEY).orderBy("coord", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("p", F.coalesce(F.max("piece").over(before), "last")).where("row is not null")
    inside = F.col("coord").isNotNull() & F.coalesce(F.col("coord") < F.col("p.to"), F.lit(False))
    found = found.withColumn("p", F.when(inside, F.col("p")))
    step = F.col("coord") - F.col("p.at")
    source = F.when(F.col("p.is_reverse"), F.col("p.end") - 1 - step).otherwise(F.col("p.start") + step)
    return found.select("row.*", "p.ord", "p.src_chrom", source.alias("src_coord"), F.col("p.ord").isNull().alias("outside"))
