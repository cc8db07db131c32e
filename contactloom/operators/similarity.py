"""Similarity of contact maps by stratum-adjusted correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, dealt
from ..plans.lineage import cut
from .balance import OWN_CELLS
from .boxes import box_sums
from .maps import CELL, subsample, subsamples

#: Cells of a diagonal and samples of a group that are multiplied in one task; samples of a group whose contacts are smoothed there too.
BLOCK, SIDE, NEAR = 4096, 512, 128
#: Numbers that are smoothed at a time where a task has all contacts of a chromosome.
ROOM = 1 << 23


def smooth(cells: DataFrame, halves: list[int], band: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, half, CELL, value): upper cells up to `band` from the diagonal of whole maps after mean filters of (2 half + 1) x (2 half + 1) cells, cut at
    the edges, for all of `halves`."""
    n, h = F.col("n"), F.col("half")
    near = cells.where(F.abs(F.col("bin1") - F.col("bin2")) <= band + 2 * max(halves))
    width = lambda b: F.least(F.col(b) + h, n - 1) - F.greatest(F.col(b) - h, F.lit(0)) + 1
    return box_sums(near, halves, by, band, upper=True).select(*by, "half", *CELL, (F.col("total") / (width("bin1") * width("bin2"))).alias("value"))


def strata(smoothed: DataFrame, pairs: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(by, sample_a, sample_b, chrom, n, d, cells, r1, r2): covariance and root of variances of each diagonal d over the cells that either has.

    Sums over the cells that two samples have are products of matrices of samples and `block` cells of a diagonal, for all pairs of groups of
    `side` samples.  A cell goes to as many tasks as there are groups, and what is shuffled after is one row for each pair and block,
    not one for each pair and cell.
    """
    places = [*by, "chrom", "n", "d"]
    numbers, table = _numbered(smoothed, pairs)
    groups = -(-len(numbers) // side)
    cells = smoothed.where("value <> 0").join(table, "sample").withColumns({"d": F.col("bin2") - F.col("bin1"), "part": F.floor(F.col("bin1") / block), "own": F.floor(F.col("number") / side)})
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long")))
    met = cells.withColumn("other", other).select(*places, "part", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "number", (F.col("bin1") % block).alias("at"), "value")

    def run(table: pa.Table) -> pa.Table:
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        number, at, value = (table[c].to_numpy() for c in ("number", "at", "value"))
        place = np.unique(at, return_inverse=True)[1]
        grids = []
        for g in (one, two):
            mine = number // side == g
            samples, row = np.unique(number[mine], return_inverse=True)
            x = np.zeros((len(samples), place.max() + 1))
            x[row, place[mine]] = value[mine]
            grids.append((samples, x))
        (a, x), (b, y) = grids
        both = (x != 0).astype(np.float64) @ (y != 0).T.astype(np.float64)
        products = x @ y.T
        i, j = np.nonzero((both > 0) & (a[:, None] <= b[None, :]))
        fixed = [pa.array([table[c][0].as_py()] * len(i), table.schema.field(c).type) for c in places]
        return pa.table([*fixed, pa.array(a[i]), pa.array(b[j]), pa.array(both[i, j].astype(np.int64)), pa.array(products[i, j])], names=[*places, "a", "b", "both", "xy"])

    kinds = dict(met.dtypes)
    made = ", ".join([*[f"{c} {kinds[c]}" for c in places], "a long, b long, both long, xy double"])
    together = met.groupBy(*places, "part", "one", "two").applyInArrow(run, made).groupBy(*places, "a", "b").agg(F.sum("both").alias("both"), F.sum("xy").alias("xy"))
    own = cut(cells.groupBy(*places, "number").agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")))
    return _told(together, own, pairs, numbers, table, by)


def _numbered(cells: DataFrame, pairs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Numbers of the samples that pairs name, in their order, and (sample, number)."""
    names = pairs.select(F.explode(F.array("sample_a", "sample_b")).alias("sample")).distinct()
    numbers = {r.sample: k for k, r in enumerate(names.orderBy("sample").collect())}  # a row for each sample
    return numbers, F.broadcast(cells.sparkSession.createDataFrame(list(numbers.items()), "sample string, number long"))


def _told(together: DataFrame, own: DataFrame, pairs: DataFrame, numbers: dict[str, int], table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """strata() from sums over the cells that samples a <= b share, (by, chrom, n, d, a, b, both, xy), and over each one's own, (by, chrom, n, d, number, k,
    s, q)."""
    spark, places = own.sparkSession, [*by, "chrom", "n", "d"]
    # Pairs of which neither has a cell on a diagonal have no stratum there; of those with one only the other's sums are 0.
    asked = cut(pairs.join(table.withColumnsRenamed({"sample": "sample_a", "number": "na"}), "sample_a").join(F.broadcast(spark.createDataFrame(list(numbers.items()), "sample_b string, nb long")), "sample_b"))
    sides = []
    for mine, kept in (("na", "a"), ("nb", "b")):
        sums = own.select(*places, F.col("number").alias(mine), *[(F.col(c) if x == kept else F.lit(0).cast(kind)).alias(c + x) for x in "ab" for c, kind in (("k", "long"), ("s", "double"), ("q", "double"))])
        sides.append(sums.join(F.broadcast(asked), mine).select(*places, "sample_a", "sample_b", "na", "nb", *[c + x for x in "ab" for c in "ksq"], F.lit(0).cast("long").alias("both"), F.lit(0.0).alias("xy")))
    turned = F.col("na") > F.col("nb")
    low = asked.withColumns({"a": F.when(turned, F.col("nb")).otherwise(F.col("na")), "b": F.when(turned, F.col("na")).otherwise(F.col("nb"))})
    shared = together.join(F.broadcast(low), ["a", "b"]).select(*places, "sample_a", "sample_b", "na", "nb", *[F.lit(0).cast("long" if c == "k" else "double").alias(c + x) for x in "ab" for c in "ksq"], "both", "xy")
    total = sides[0].unionByName(sides[1]).unionByName(shared).groupBy(*places, "sample_a", "sample_b").agg(*[F.sum(c).alias(c) for c in ("ka", "sa", "qa", "kb", "sb", "qb", "both", "xy")])
    k = F.col("ka") + F.col("kb") - F.col("both")
    # What is left of sums that cancel is no variance.
    spread = lambda x: F.when(F.col(f"q{x}") / k - F.col(f"s{x}") / k * F.col(f"s{x}") / k > 1e-12 * F.col(f"q{x}") / k, F.col(f"q{x}") / k - F.col(f"s{x}") / k * F.col(f"s{x}") / k).otherwise(0.0)
    of = F.sqrt(spread("a") * spread("b")).alias("r2")
    return total.select(*by, "sample_a", "sample_b", "chrom", "n", "d", k.alias("cells"), (F.col("xy") / k - F.col("sa") / k * F.col("sb") / k).alias("r1"), of)


def adjusted(strata: DataFrame, length: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample_a, sample_b, scc) from strata, weighted by cells times the root of variances, and chromosomes by length."""
    each = strata.groupBy(*by, "sample_a", "sample_b", "chrom", "n").agg(F.sum(F.col("cells") * F.col("r1")).alias("a"), F.sum(F.col("cells") * F.col("r2")).alias("b"))
    return _by_length(each, length, by)


def _by_length(each: DataFrame, length: Column | None, by: tuple[str, ...]) -> DataFrame:
    """adjusted() from its weighted sums a and b of each chromosome."""
    each = each.where("b > 0").withColumn("scc", F.col("a") / F.col("b")).withColumn("w", F.col("n") if length is None else length)
    return each.groupBy(*by, "sample_a", "sample_b").agg((F.sum(F.col("w") * F.col("scc")) / F.sum("w")).alias("scc"))


def scc(cells: DataFrame, pairs: DataFrame, max_dist: int, h: int, length: Column | None = None) -> DataFrame:
    """(sample_a, sample_b, scc): stratum-adjusted correlation of the pairs' whole maps up to max_dist bins from the diagonal.

    Maps are smoothed by h; strata are weighted by cells times the root of variances, chromosomes by length (number of bins unless
    given).  Null where no stratum varies on both sides.
    """
    return adjusted(strata(smooth(cells, [h], max_dist).drop("half"), pairs), length)


def sample_pairs(cells: DataFrame) -> DataFrame:
    """(sample_a, sample_b) of all samples, the lower one first."""
    names = cells.select(F.col("sample").alias("sample_a")).distinct()
    return names.join(names.withColumnRenamed("sample_a", "sample_b"), F.col("sample_a") < F.col("sample_b"))


def contact_strata(upper: DataFrame, pairs: DataFrame, halves: list[int], band: int, by: tuple[str, ...] = (), block: int = BLOCK, side: int = NEAR) -> DataFrame:
    """strata() with `half` after smooth(), by (by, half), for all of `halves` of upper maps of whole numbers of contacts.

    No smoothed cell is written: a task has the contacts of two groups of `side` samples round `block` bins of the diagonal, smooths them one
    size after the other and multiplies them at once.  A contact goes to two blocks at most, for each other group of samples.
    """
    reach = max(halves)
    wide = band + 2 * reach
    block = max(block, wide + 2 * reach)
    places = [*by, "half", "chrom", "n", "d"]
    numbers, table = _numbered(upper, pairs)
    groups = -(-len(numbers) // side)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long")))
    last = F.floor((F.col("n") - 1) / block)
    part = lambda b: F.greatest(F.least(F.floor(b / block), last), F.lit(0))
    near = upper.where((F.col("value") != 0) & (F.col("bin2") - F.col("bin1") <= wide)).join(table, "sample")
    near = near.select(*by, "chrom", "n", "number", "bin1", "bin2", "value", F.explode(F.array_distinct(F.array(part(F.col("bin1") - reach), part(F.col("bin2") + reach)))).alias("part"))
    own = F.floor(F.col("number") / side)
    met = near.withColumn("other", other).select(*by, "chrom", "n", "part", F.least(own, "other").alias("one"), F.greatest(own, "other").alias("two"), "number", "bin1", "bin2", "value")

    def run(cells: pa.Table) -> pa.Table:
        one, two, n, first = (cells[c][0].as_py() for c in ("one", "two", "n", "part"))
        first *= block
        size = min(block, n - first)
        number, r, c, v = (cells[k].to_numpy() for k in ("number", "bin1", "bin2", "value"))
        # Both halves of the whole map as (column - row, row).
        number, o, r, v = np.concatenate([number, number[r != c]]), np.concatenate([c - r, (r - c)[r != c]]), np.concatenate([r, c[r != c]]), np.concatenate([v, v[r != c]])
        o, r = o + wide, r - first + reach
        kept = (r >= 0) & (r < size + 2 * reach)
        at = np.argsort(number[kept], kind="stable")
        number, o, r, v = (x[kept][at] for x in (number, o, r, v))
        samples, starts = np.unique(number, return_index=True)
        ends = np.append(starts[1:], len(number))
        mine = [np.flatnonzero(samples // side == g) for g in (one, two)]
        place = first + np.arange(size)
        parts = []
        for h in halves:
            x = np.zeros((band + 1, len(samples), size))
            width = lambda b: np.minimum(b + h, n - 1) - np.maximum(b - h, 0) + 1  # noqa: B023, E731
            for k in range(len(samples)):
                sums = np.zeros((2 * wide + 2, size + 2 * reach))
                np.add.at(sums, (o[starts[k] : ends[k]] + 1, r[starts[k] : ends[k]]), v[starts[k] : ends[k]])
                np.cumsum(sums, axis=0, out=sums)
                for d in range(band + 1):
                    for a in range(-h, h + 1):
                        row = slice(reach + a, reach + a + size)
                        x[d, k] += sums[wide + d - a + h + 1, row] - sums[wide + d - a - h, row]
            for d in range(min(band, n - 1) + 1):
                inside = place + d < n
                y = np.where(inside, x[d] / np.where(inside, width(place) * width(place + d), 1), 0.0)
                a, b = y[mine[0]], y[mine[1]]
                both, products = (a != 0).astype(np.float64) @ (b != 0).T.astype(np.float64), a @ b.T
                i, j = np.nonzero((both > 0) & (samples[mine[0]][:, None] <= samples[mine[1]][None, :]))
                parts.append((np.full(len(i), h), np.full(len(i), d), samples[mine[0]][i], samples[mine[1]][j], both[i, j].astype(np.int64), products[i, j], np.where(samples[mine[0]][i] == samples[mine[1]][j], a.sum(1)[i], 0.0)))
        made = [np.concatenate(z) for z in zip(*parts)]
        fixed = [pa.array([cells[k][0].as_py()] * len(made[0]), cells.schema.field(k).type) for k in (*by, "chrom", "n")]
        return pa.table([*fixed, *[pa.array(z) for z in made]], names=[*by, "chrom", "n", "half", "d", "a", "b", "both", "xy", "s"])

    kinds = dict(met.dtypes)
    made = met.groupBy(*by, "chrom", "n", "part", "one", "two").applyInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in (*by, "chrom", "n")], "half long, d long, a long, b long, both long, xy double, s double"]))
    together = cut(made.groupBy(*places, "a", "b").agg(*[F.sum(k).alias(k) for k in ("both", "xy", "s")]))
    each = together.where("a = b").select(*places, F.col("a").alias("number"), F.col("both").alias("k"), "s", F.col("xy").alias("q"))
    return _told(together.drop("s"), each, pairs, numbers, table, (*by, "half"))


def contact_scores(upper: DataFrame, pairs: DataFrame, halves: list[int], band: int, by: tuple[str, ...] = (), side: int = NEAR, own_cells: int = OWN_CELLS, room: int = ROOM) -> DataFrame:
    """adjusted() of contact_strata(), by (by, half).

    A task has all contacts near the diagonal of a chromosome of two groups of `side` samples, smooths `room` numbers of them at a time, adds up the
    products of their pairs and gives one row for each pair and size, so that no row is shuffled for each pair and diagonal.  Chromosomes on which
    two groups have more than own_cells contacts there go by contact_strata().
    """
    reach = max(halves)
    wide = band + 2 * reach
    numbers, table = _numbered(upper, pairs)
    groups = -(-len(numbers) // side)
    own = F.floor(F.col("number") / side)
    near = upper.where((F.col("value") != 0) & (F.col("bin2") - F.col("bin1") <= wide)).join(table, "sample")
    # A row for each chromosome with too many contacts.
    counts = near.groupBy(*by, "chrom", "n", own.alias("own")).agg(F.count(F.lit(1)).alias("k")).groupBy("chrom").agg(F.max("k").alias("k"))
    large = [r.chrom for r in counts.where(F.col("k") * min(2, groups) > own_cells).collect()]
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long")))
    met = near.where(~F.col("chrom").isin(large)).withColumn("other", other).select(*by, "chrom", "n", F.least(own, "other").alias("one"), F.greatest(own, "other").alias("two"), "number", "bin1", "bin2", "value")

    def run(cells: pa.Table) -> pa.Table:
        one, two, n = (cells[c][0].as_py() for c in ("one", "two", "n"))
        number, r, c, v = (cells[k].to_numpy() for k in ("number", "bin1", "bin2", "value"))
        samples, k = np.unique(number, return_inverse=True)
        # Both halves of the whole map as (column - row, row), in order of rows.
        k, o, r, v = np.concatenate([k, k[r != c]]), np.concatenate([c - r, (r - c)[r != c]]), np.concatenate([r, c[r != c]]), np.concatenate([v, v[r != c]])
        order = np.argsort(r, kind="stable")
        k, o, r, v = k[order], o[order], r[order], v[order]
        mine = [slice(*np.searchsorted(samples, (g * side, (g + 1) * side))) for g in (one, two)]
        a, b = (x.stop - x.start for x in mine)
        ds, lines = min(band, n - 1) + 1, 2 * wide + 3
        both, xy = np.zeros((len(halves), ds, a, b)), np.zeros((len(halves), ds, a, b))
        held, s, q = (np.zeros((len(halves), ds, len(samples))) for _ in range(3))
        step = max(wide, room // (len(samples) * lines))
        for first in range(0, n, step):
            size = min(step, n - first)
            cols = size + 2 * reach + 1
            near = slice(*np.searchsorted(r, (first - reach, first + size + reach)))
            if near.start == near.stop:
                continue
            # Sums over the columns up to each one, then over the rows up to each one along a column: a window is told by its four corners.
            at = (k[near] * lines + o[near] + wide + 1) * cols + r[near] - first + reach + 1
            sums = np.bincount(at, v[near], len(samples) * lines * cols).reshape(len(samples), lines, cols)
            np.cumsum(sums, axis=1, out=sums)
            for line in range(lines - 2, -1, -1):
                sums[:, line, 1:] += sums[:, line + 1, :-1]
            place = first + np.arange(size)
            for x, h in enumerate(halves):
                upto, before = slice(reach + h + 1, reach + h + 1 + size), slice(reach - h, reach - h + size)
                width = lambda b: np.minimum(b + h, n - 1) - np.maximum(b - h, 0) + 1  # noqa: B023, E731
                for d in range(ds):
                    inside = max(0, min(size, n - d - first))
                    y = sums[:, wide + d + 1, upto] - sums[:, wide + d + 2 * h + 2, before] - sums[:, wide + d - 2 * h, upto] + sums[:, wide + d + 1, before]
                    y = y[:, :inside] / (width(place) * width(place + d))[:inside]
                    some = (y != 0).astype(np.float32)
                    both[x, d] += some[mine[0]] @ some[mine[1]].T
                    xy[x, d] += y[mine[0]] @ y[mine[1]].T
                    held[x, d] += some.sum(1)
                    s[x, d] += y.sum(1)
                    q[x, d] += np.einsum("ij,ij->i", y, y)
        parts = []
        for x, h in enumerate(halves):
            over, under = np.zeros((a, b)), np.zeros((a, b))
            for d in range(ds):
                ka, kb = (held[x, d, g] for g in mine)
                cells_of = ka[:, None] + kb[None, :] - both[x, d]
                count = np.maximum(cells_of, 1)
                sa, sb, qa, qb = s[x, d, mine[0]][:, None] / count, s[x, d, mine[1]][None, :] / count, q[x, d, mine[0]][:, None] / count, q[x, d, mine[1]][None, :] / count
                # What is left of sums that cancel is no variance.
                va, vb = (np.where(q - s * s > 1e-12 * q, q - s * s, 0.0) for q, s in ((qa, sa), (qb, sb)))
                over += cells_of * (xy[x, d] / count - sa * sb)
                under += cells_of * np.sqrt(va * vb)
            i, j = np.nonzero((under > 0) & (samples[mine[0]][:, None] <= samples[mine[1]][None, :]))
            parts.append((np.full(len(i), h), samples[mine[0]][i], samples[mine[1]][j], over[i, j], under[i, j]))
        made = [np.concatenate(z) for z in zip(*parts)]
        fixed = [pa.array([cells[k][0].as_py()] * len(made[0]), cells.schema.field(k).type) for k in (*by, "chrom", "n")]
        return pa.table([*fixed, *[pa.array(z) for z in made]], names=[*by, "chrom", "n", "half", "low", "high", "a", "b"])

    kinds = dict(met.dtypes)
    made = met.groupBy(*by, "chrom", "n", "one", "two").applyInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in (*by, "chrom", "n")], "half long, low long, high long, a double, b double"]))
    names = F.broadcast(pairs.join(table.withColumnsRenamed({"sample": "sample_a", "number": "na"}), "sample_a").join(table.withColumnsRenamed({"sample": "sample_b", "number": "nb"}), "sample_b").select("sample_a", "sample_b", F.least("na", "nb").alias("low"), F.greatest("na", "nb").alias("high")))
    each = made.join(names, ["low", "high"]).select(*by, "half", "sample_a", "sample_b", "chrom", "n", "a", "b")
    if large:
        told = contact_strata(upper.where(F.col("chrom").isin(large)), pairs, halves, band, by)
        each = each.unionByName(told.groupBy(*by, "half", "sample_a", "sample_b", "chrom", "n").agg(F.sum(F.col("cells") * F.col("r1")).alias("a"), F.sum(F.col("cells") * F.col("r2")).alias("b")))
    return _by_length(each, None, (*by, "half"))


def train_h(upper: DataFrame, max_dist: int, h_max: int = 10, repeats: int = 10, gain: float = 0.01, share: float = 0.1) -> int:
    """The smallest smoothing whose next step gains less than `gain` for a pair, at most over all pairs of samples.

    Means over `repeats` seeded subsamples with that share of each sample's contacts.  All draws and all smoothings are one job, whose tasks smooth
    and multiply contacts without writing a smoothed cell.
    """
    totals = cut(upper.groupBy("sample").agg(F.floor(F.sum("value") * share).cast("long").alias("size")))
    draws = cut(subsamples(upper, totals, list(range(repeats))))
    each = contact_scores(draws, sample_pairs(upper), list(range(h_max + 1)), max_dist, ("draw",))
    means = each.groupBy("sample_a", "sample_b", "half").agg(F.avg("scc").alias("scc"))
    curves: dict[tuple[str, str], dict[int, float]] = {}
    for r in means.collect():  # h_max + 1 rows for each pair of samples
        curves.setdefault((r.sample_a, r.sample_b), {})[r.half] = r.scc
    steps = lambda curve: (h for h in range(h_max) if h in curve and h + 1 in curve and curve[h + 1] - curve[h] < gain)
    return max((next(steps(curve), h_max) for curve in curves.values()), default=0)


def hicrep_matrix(upper: DataFrame, max_dist: int, size: int = 0, h: int = 0, seed: int = 0) -> DataFrame:
    """(sample_a, sample_b, scc) of all ordered pairs of samples, 1 for each with itself; maps are first cut to `size` contacts, 0: to
    the smallest sample's."""
    totals = upper.groupBy("sample").agg(F.sum("value").cast("long").alias("total"))
    wanted = totals.select("sample", F.lit(size).cast("long").alias("size")) if size else totals.join(totals.agg(F.min("total").alias("size")).hint("broadcast")).select("sample", "size")
    found = contact_scores(cut(subsample(upper, wanted, seed)), sample_pairs(upper), [h], max_dist).drop("half")
    mirrored = found.select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "scc")
    own = upper.select(F.col("sample").alias("sample_a"), F.col("sample").alias("sample_b"), F.lit(1.0).alias("scc")).distinct()
    return found.unionByName(mirrored).unionByName(own)


def cluster_order(matrix: DataFrame, share: float = 0.5) -> DataFrame:
    """(sample, cluster, place): samples in an order that puts alike ones side by side, from all ordered pairs (sample_a, sample_b, scc).

    Samples are rows of the matrix; of all groups the two whose farthest members are nearest are joined, until these are farther
    apart than `share` of the largest distance.  Clusters are numbered by their first sample, after which they are named until then.  In each
    round all groups are joined that are each other's nearest, which gives the same clusters as one after another, since a joined group
    is never nearer to others than its parts were; distances stay rows of pairs.
    """
    rows = cut(matrix.select("sample_a", "sample_b", F.coalesce("scc", F.lit(0.0)).alias("scc")))
    one, two = rows.select(F.col("sample_a").alias("a"), "sample_b", F.col("scc").alias("x")), rows.select(F.col("sample_a").alias("b"), "sample_b", F.col("scc").alias("y"))
    apart = F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))))
    far = cut(one.join(two, "sample_b").where("a < b").groupBy("a", "b").agg(apart.alias("d")))
    limit = share * (far.agg(F.max("d")).first()[0] or 0.0)
    state = cut(rows.select(F.col("sample_a").alias("sample"), F.col("sample_a").alias("cluster")).distinct())
    while True:
        ends = far.select(F.explode(F.array("a", "b")).alias("end"), F.struct("d", "a", "b").alias("pair"))
        chosen = ends.groupBy("end").agg(F.min("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        joined = cut(chosen.where((F.col("n") == 2) & (F.col("pair.d") <= limit)).select(F.col("pair.b").alias("gone"), F.col("pair.a").alias("into")))
        if joined.isEmpty():
            break
        moved = lambda df, c: df.join(joined, F.col(c) == F.col("gone"), "left").withColumn(c, F.coalesce("into", c)).drop("gone", "into")  # noqa: B023, E731
        state = cut(moved(state, "cluster"))
        both = moved(moved(far, "a"), "b").where("a <> b")
        far = cut(both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d")))
    first = F.when(F.col("sample") == F.col("cluster"), 1).otherwise(0)
    placed = dealt(state.withColumns({"all": F.lit(0), "first": first}), ["all"], "cluster", "sample")
    placed = carried(placed, ["all"], before=(F.count(F.lit(1)), F.sum("before")), clusters=(F.sum("first"), F.sum("clusters")))
    own = Window.partitionBy("block").orderBy("cluster", "sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = lambda base, of: (F.coalesce(base, F.lit(0)) + F.sum(of).over(own) - 1).cast("int")
    return placed.select("sample", number("clusters", F.col("first")).alias("cluster"), number("before", F.lit(1)).alias("place"))
