"""Joins on a key of which a few values may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: A value is hot if more than one in HOT rows have it, so that there are fewer than HOT of them.
HOT = 1000


def look_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """`rows` joined with the one row that `table` has for each value of column `on`; rows without one go.

    Rows of hot values meet their fewer than HOT rows of `table`, which are broadcast; all others are shuffled.  `rows` is read three
    times and should be cut before.
    """
    n = rows.count()
    hot = cut(rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT > n).select(on))
    some = F.broadcast(cut(table.join(F.broadcast(hot), on, "left_semi")))
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(table, on)
    return rows.join(some, on).unionByName(rest)
