"""Sums of square windows round the cells of a map, for several sizes of window at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEY

#: Rows and columns of a tile at least.
TILE = 128
#: Rows that a task makes at a time, about; it reads a quarter of that.
ROWS = 1 << 18


def box_sums(cells: DataFrame, halves: list[int], by: tuple[str, ...] = (), band: int | None = None, upper: bool = False, tile: int = TILE) -> DataFrame:
    """(by, sample, chrom, n, half, bin1, bin2, stored, total): for each cell whose window has a stored one how many it has, and their sum.

    A window has 2 half + 1 rows and columns, less what is off the map.  Cells go to the tiles of the map that a largest window round them
    touches, four at most whatever its size.  A task goes through its sorted tiles; those with few cells are summed together, cell by cell,
    so that the work is that of the cells and not of the map's length, the others each by one table of prefix sums.  With `upper` only cells
    on and above the diagonal are given, with `band` only those up to that distance from it.  by names further columns that tell maps apart.
    """
    reach, keys = max(halves), [*by, *KEY, "n"]
    size = max(tile, 2 * reach)
    last = F.floor((F.col("n") - 1) / size)
    touched = lambda b: F.array_distinct(F.array(F.greatest(F.floor((F.col(b) - reach) / size), F.lit(0)), F.least(F.floor((F.col(b) + reach) / size), last)))
    placed = cells.select(*keys, F.explode(touched("bin1")).alias("tile1"), "bin1", "bin2", F.col("value").cast("double").alias("value"))
    placed = placed.withColumn("tile2", F.explode(touched("bin2")))
    below, apart = F.col("tile1") > F.col("tile2"), (F.abs(F.col("tile1") - F.col("tile2")) - 1) * size + 1
    placed = placed.where(~below) if upper else placed
    placed = placed.where(apart <= band) if band is not None else placed
    # One row and column of zeros before all others, so that a window is four corners of the prefix sums.
    side, widest = size + 2 * reach + 1, max((2 * h + 1) ** 2 for h in halves)

    def wanted(rows: np.ndarray, columns: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        found = (rows < n) & (columns < n)
        found &= (columns >= rows) if upper else True
        return found & (abs(columns - rows) <= band) if band is not None else found

    def dense(i0: int, j0: int, n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
        sums, counts = np.zeros((side, side)), np.zeros((side, side), np.int64)
        np.add.at(sums, (i - i0 + reach + 1, j - j0 + reach + 1), value)
        np.add.at(counts, (i - i0 + reach + 1, j - j0 + reach + 1), 1)
        for grid in (sums, counts):
            np.cumsum(grid, axis=0, out=grid)
            np.cumsum(grid, axis=1, out=grid)
        rows, columns = np.meshgrid(np.arange(i0, i0 + size), np.arange(j0, j0 + size), indexing="ij")
        inside = wanted(rows, columns, n)
        for h in halves:
            lo, hi = reach - h, reach + h + 1
            corners = lambda g: g[hi : hi + size, hi : hi + size] - g[lo : lo + size, hi : hi + size] - g[hi : hi + size, lo : lo + size] + g[lo : lo + size, lo : lo + size]  # noqa: B023, E731
            k = corners(counts)
            at = inside & (k > 0)
            yield h, rows[at], columns[at], k[at], corners(sums)[at]

    def sparse(first: np.ndarray, number: np.ndarray, t1: np.ndarray, t2: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
        """Windows of cells of several tiles; number tells a cell's tile, first the tile's first row."""
        # A cell's number in its tile, which is framed so that no window leaves it.
        frame = size + 4 * reach
        own = (number * frame + (i - t1 * size + 2 * reach)) * frame + (j - t2 * size + 2 * reach)
        for h in halves:
            step = np.arange(-h, h + 1)
            place = np.add.outer(own, np.add.outer(step * frame, step).ravel()).ravel()
            order = np.argsort(place)
            place = place[order]
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            order //= len(step) ** 2
            counts, sums = np.diff(np.r_[start, len(place)]), np.add.reduceat(value[order], start)
            head, place = order[start], place[start]
            r, c = (x - 2 * reach for x in np.divmod(place % (frame * frame), frame))
            rows, columns = t1[head] * size + r, t2[head] * size + c
            at = np.flatnonzero((r >= 0) & (r < size) & (c >= 0) & (c < size) & wanted(rows, columns, n[head]))
            yield h, first[head[at]], rows[at], columns[at], counts[at], sums[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles(table: pa.Table) -> np.ndarray:
            """The first row of each tile."""
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in (*keys, "tile1", "tile2"):
                column = table[c].combine_chunks()
                codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return np.flatnonzero(new)

        def written(table: pa.Table, h: int, first: np.ndarray, *made: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(first), ROWS):
                part = [x[k : k + ROWS] for x in made]
                fixed = [table[c].take(pa.array(first[k : k + ROWS])).combine_chunks() for c in keys]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(part[0]), h)), *[pa.array(x) for x in part]], names=[*keys, *[x.split()[0] for x in made_columns]])

        def summed(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.r_[starts[1:], table.num_rows]
            t1, t2, n, i, j, value = (table[c].to_numpy() for c in ("tile1", "tile2", "n", "bin1", "bin2", "value"))
            few = (ends - starts) * widest <= side * side
            for a, b in zip(starts[~few], ends[~few], strict=True):
                for h, *made in dense(int(t1[a]) * size, int(t2[a]) * size, int(n[a]), i[a:b], j[a:b], value[a:b]):
                    yield from written(table, h, np.full(len(made[0]), a), *made)
            number = np.repeat(np.arange(len(starts)), ends - starts)
            rows = np.flatnonzero(few[number])
            # Whole tiles together, as many as make up the rows of a batch; one with few cells has no more than that.
            share = np.cumsum(np.where(few, (ends - starts) * widest, 0)) // max(ROWS, side * side)
            for at in np.split(rows, np.flatnonzero(np.diff(share[number[rows]])) + 1) if len(rows) else []:
                for h, *made in sparse(starts[number[at]], number[at] - number[at[0]], *(x[at] for x in (t1, t2, n, i, j, value))):
                    yield from written(table, h, *made)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS // 4:
                continue
            table = pa.Table.from_batches(held)
            starts = tiles(table)
            # The last tile may go on in the next batch.
            if len(starts) > 1:
                yield from summed(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, rows = table.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from summed(table, tiles(table))

    made_columns = ("half long", "bin1 long", "bin2 long", "stored long", "total double")
    kinds = dict(placed.dtypes)
    sorted_tiles = placed.repartition(*keys, "tile1", "tile2").sortWithinPartitions(*keys, "tile1", "tile2")
    return sorted_tiles.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keys], *made_columns]))
