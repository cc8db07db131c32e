"""Exact percentiles of groups that are too large for one task: the wanted ranks are found by histograms of narrowing ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY
from ..plans.lineage import cut

#: Ranges of a histogram, and distinct values that are put in order at last, of each group.
RANGES, FEW = 4096, 1 << 16


def percentile_of(rows: DataFrame, value: str, p: float, by: tuple[str, ...] = KEY, weight: str | None = None, name: str = "percentile", few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """(by, name): the p-th percentile, p from 0 to 1, of each group's values, between two ranks as a straight line; nulls are left out.

    weight is how many times a row counts.  A group's two ranks are each looked for in a range of values: a histogram of `ranges` parts of it tells the
    part that holds the rank, which is the next range, from its least to its greatest value, until it has at most `few` distinct values or
    one.  Only those are put in order.  Groups with few rows need no histogram; none is held by one task.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    kept = rows.select(*by, F.col(value).cast("double").alias("v"), times.alias("w")).where("v is not null and w > 0").groupBy(*by, "v").agg(F.sum("w").alias("w"))
    kept = cut(kept)
    at = (F.col("total") - 1) * p
    groups = kept.groupBy(*by).agg(F.sum("w").alias("total"), F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("held")).withColumn("at", at)
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank")))).alias("x")
    ranks = cut(groups.select(*by, "at", "a", "b", "held", side).select(*by, "at", "a", "b", "held", "x.side", "x.rank", F.col("x.rank").alias("left")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    within = F.col("v").between(F.col("a"), F.col("b"))
    for s in same:
        within = within & s
    near = lambda state: kept.join(state.withColumnsRenamed({c: f"_{c}" for c in by}), within)
    key = [*[F.col(f"_{c}").alias(c) for c in by], "side", "at", "rank"]
    wide = f"held > {few} and a < b"
    while not ranks.where(wide).isEmpty():
        # Numbers from a to b that are nearer than doubles tell apart fall into one part, which is then its own range.
        part = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * ranges), F.lit(ranges - 1)).alias("part")
        counted = near(ranks.where(wide)).groupBy(*key, "left", part).agg(F.sum("w").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("held"))
        upto = F.sum("w").over(Window.partitionBy(*by, "side").orderBy("part"))
        found = counted.withColumn("before", upto - F.col("w")).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("w")))
        narrower = found.select(*by, "at", "a", "b", "held", "side", "rank", (F.col("left") - F.col("before")).alias("left"))
        ranks = cut(ranks.where(f"not ({wide})").unionByName(narrower))
    order = Window.partitionBy(*by, "side").orderBy("v")
    last = near(ranks).select(*key, "left", "v", "w").withColumn("upto", F.sum("w").over(order)).where("upto > left").groupBy(*by, "side", "at", "rank").agg(F.min("v").alias("v"))
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    share = F.first("at") - F.floor(F.first("at"))
    return last.groupBy(*by).agg(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
