"""Orders inside groups of which one may hold a large share of all rows: parts of a sort by range, and one carried row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def dealt(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """`rows` with `block`: parts of the sorted rows, none larger than a shuffle partition, however many rows have the same `by`."""
    return cut(rows.repartitionByRange(*by, *order).withColumn("block", F.spark_partition_id()))


def carried(rows: DataFrame, by: list[str], **folds: tuple[Column, Column]) -> DataFrame:
    """Rows of dealt() with, for each name, a fold of all earlier blocks of their `by`: (what folds a block, what folds those)."""
    each = rows.groupBy(*by, "block").agg(*[inside.alias(name) for name, (inside, _) in folds.items()])
    past = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("block").alias("_block"), *[over.over(past).alias(name) for name, (_, over) in folds.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    on = F.col("block") == F.col("_block")
    for s in same:
        on = on & s
    return rows.join(before, on).drop("_block", *[f"_{c}" for c in by])
