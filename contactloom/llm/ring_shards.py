"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Keys and shards' virtual nodes lie on a ring.  Going round it once, each key joins the next virtual node clockwise whose shard is
not yet full; full shards are passed over, so that what overflows continues clockwise.  Capacities add up to the total, so that
balance is exact, while most keys stay where the plain ring has them when a shard is added.

The walk needs no row by row: the ring is cut into CELLS cells, whose loads are one small aggregate; between two moments at which a
shard fills up, whole cells join the next open node, and a cell in which a shard fills up is cut at a rank.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, dealt
from ..plans.lineage import cut

#: Cells of the ring; the loads of all are what the driver sees, whatever the number of rows.
CELLS = 1 << 16
VIRTUAL_NODES = 64
#: Rows of a run of equal ones that are written out together.
PIECE = 1 << 16


def nodes(shards: int, virtual: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a node stands at the end of its cell."""
    place = lambda s, k: int.from_bytes(hashlib.sha256(f"shard {s} node {k}".encode()).digest()[:8], "big") % cells
    return sorted((place(s, k), s) for s in range(shards) for k in range(virtual))


def walk(loads: dict[int, int], capacity: list[int], virtual: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """(cell, start, end, shard): which part of each cell's load, from start to before end, joins which shard.

    Cells are walked from 0; capacities must add up to the loads' total at least.
    """
    ring = nodes(len(capacity), virtual, cells)
    # The shards in the order in which they come clockwise from each node.
    onward = [list(dict.fromkeys(s for _, s in ring[at:] + ring[:at])) for at in range(len(ring))]
    room = list(capacity)
    out = []
    at = 0
    for cell in sorted(loads):
        while at < len(ring) and ring[at][0] < cell:
            at += 1
        start, load = 0, loads[cell]
        for shard in onward[at % len(ring)]:
            taken = min(room[shard], load - start)
            if taken:
                out.append((cell, start, start + taken, shard))
                start, room[shard] = start + taken, room[shard] - taken
            if start == load:
                break
    return out


def even_capacity(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Equal capacities, one apart at most, that hold the total; each larger by the share `slack`."""
    return [int((total // shards + (s < total % shards)) * (1 + slack)) + (slack > 0) for s in range(shards)]


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weight: str = "rows", slack: float = 0.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot), a row for each row of `df`.

    size is the text's UTF-8 bytes (a null has none) plus 1, text_crc32 its unsigned checksum (of a null, that of no bytes).
    weight says what is balanced: `rows`, whose numbers in two shards then differ by one at most (without slack), or `bytes`, whose
    sums then differ by a few rows' sizes.  With slack a shard may hold that share more, and fewer rows move when shards are added.
    slot numbers a shard's rows from 0 without gaps.  Rows lie on the ring by a hash of their key, those with a null key by
    one of their text; of equal places the lower key and checksum goes first; repeated rows are rows of their own, counted before
    they are shuffled.  An empty table gives an empty one; other columns are left out.
    """
    if weight not in ("rows", "bytes"):
        raise ValueError(weight)
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("place", F.xxhash64("key", F.when(F.col("key").isNull(), F.col("text_crc32"))))
    rows = rows.withColumn("cell", F.pmod("place", F.lit(CELLS)).cast("int"))
    # Rows that are equal in all that is returned are one run, which is dealt as a range of numbers; texts are read once.
    order = ["place", "key", "text_crc32", "size"]
    runs = dealt(cut(rows.groupBy("cell", *order).agg(F.count(F.lit(1)).alias("n"))), ["cell"], *order)
    width = F.lit(1).cast("long") if weight == "rows" else F.col("size")
    loads = {r.cell: r.load for r in runs.groupBy("cell").agg(F.sum(F.col("n") * width).cast("long").alias("load")).collect()}  # CELLS rows at most
    plan = walk(loads, even_capacity(sum(loads.values()), shards, slack))
    # The plan has a row for each cell and one more for each shard that fills up.
    parts = F.broadcast(spark.createDataFrame(plan, "cell int, start long, end long, shard int"))
    # A cell may hold a key with very many texts: its sum goes on from one block of the sorted runs to the next.
    ranked = carried(runs, ["cell"], base=(F.sum(F.col("n") * width), F.sum("base")))
    reached = F.sum(F.col("n") * width).over(Window.partitionBy("block", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumn("before", F.coalesce("base", F.lit(0)) + reached - F.col("n") * width).drop("base", "block")
    # A row belongs to the part in which it starts; a run may reach over several.
    upto = lambda edge: F.least(F.greatest(F.ceil((F.col(edge) - F.col("before")) / width), F.lit(0)), F.col("n")).cast("long")
    placed = ranked.join(parts, "cell").withColumns({"lo": upto("start"), "hi": upto("end")}).where("lo < hi")
    if weight == "rows":
        first, slots = {}, []
        for cell, start, end, shard in plan:
            slots.append((cell, start, shard, first.get(shard, 0)))
            first[shard] = first.get(shard, 0) + end - start
        bases = F.broadcast(spark.createDataFrame(slots, "cell int, start long, shard int, base long"))
        numbered = placed.join(bases, ["cell", "start", "shard"]).withColumn("from", F.col("base") + F.col("before") + F.col("lo") - F.col("start"))
    else:
        held = placed.groupBy("cell", "start", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("held"))
        sums = held.withColumn("base", F.sum("held").over(Window.partitionBy("shard").orderBy("cell", "start").rowsBetween(Window.unboundedPreceding, -1)))
        inside = Window.partitionBy("cell", "start", "shard").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
        counted = placed.withColumn("rank", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(inside), F.lit(0)))
        numbered = counted.join(sums, ["cell", "start", "shard"]).withColumn("from", F.coalesce("base", F.lit(0)) + F.col("rank"))
    ranges = numbered.select("key", "size", "text_crc32", "shard", "from", (F.col("from") + F.col("hi") - F.col("lo") - 1).alias("to"))
    long = ranges.where(F.col("to") - F.col("from") >= PIECE).withColumn("at", F.explode(F.sequence("from", "to", F.lit(PIECE).cast("long"))))
    pieces = long.withColumns({"from": F.col("at"), "to": F.least("to", F.col("at") + PIECE - 1)}).drop("at").repartition("key", "from")
    every = ranges.where(F.col("to") - F.col("from") < PIECE).unionByName(pieces)
    slotted = every.withColumn("slot", F.explode(F.sequence("from", "to")))
    return slotted.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
