"""Tracks along chromosomes: (sample, chrom, pos, value), positions that are missing or null being unknown."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, null_if_nan
from .maps import mad

#: Positions that one task smooths at a time, and positions whose values it is given together.
CHUNK, TOGETHER = 1 << 16, 1 << 20


def fill_missing(track: DataFrame) -> DataFrame:
    """Null and NaN as 0."""
    return track.withColumn("value", F.coalesce(null_if_nan(F.col("value")), F.lit(0.0)))


def _gaussian(sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def _around(track: DataFrame, chroms: DataFrame, reach: int, circular: bool) -> DataFrame:
    """The values of a track and their copies up to `reach` before and after the chromosomes (chrom, length): round the circle, or the end values."""
    rows = fill_missing(track).join(chroms.select("chrom", "length"), "chrom")
    shifts = F.array(-F.col("length"), F.lit(0).cast("long"), F.col("length")) if circular else F.array(F.lit(0).cast("long"))
    around = rows.withColumn("shift", F.explode(shifts)).withColumn("pos", F.col("pos") + F.col("shift"))
    if not circular:
        # The end values stand for all positions outside.
        outside = F.when(F.col("pos") == 0, F.sequence(F.lit(-reach).cast("long"), F.lit(0).cast("long"))).when(F.col("pos") == F.col("length") - 1, F.sequence(F.col("pos"), F.col("pos") + reach)).otherwise(F.array("pos"))
        around = around.withColumn("pos", F.explode(outside))
    return around.where((F.col("pos") >= -reach) & (F.col("pos") < F.col("length") + reach))


def smooth(track: DataFrame, chroms: DataFrame, sigma: float, circular: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Every position of the chromosomes (chrom, length) after a gaussian filter cut at four sigmas; missing positions are zeros.

    Round the circle if circular, else the ends are repeated.  A chromosome is smoothed in chunks; each gets a copy of the values
    within reach on both sides.  A task has the values of some chunks, TOGETHER positions or one chunk, and smooths those that have one.  It
    gives a row for each position that is not 0, with the zeros behind it as a range, which is written out only after the task.
    """
    weights = _gaussian(sigma)
    reach = len(weights) // 2
    around = _around(track, chroms, reach, circular)
    together = max(1, TOGETHER // chunk) * chunk
    lo, hi = F.floor((F.col("pos") - reach) / together), F.floor((F.col("pos") + reach) / together)
    parts = around.withColumn("part", F.explode(F.sequence(lo, hi))).where("part >= 0 and part * {0} < length".format(together))
    names = track.select("sample").distinct().join(chroms.select("chrom", "length"))
    empty = names.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / together))))
    empty = empty.select("sample", "chrom", "length", "part", F.lit(None).cast("long").alias("pos"), F.lit(0.0).alias("value"))

    def run(table: pa.Table) -> pa.Table:
        first = table["part"][0].as_py() * together
        end = min(first + together, table["length"][0].as_py())
        known = table.filter(pc.is_valid(table["pos"]))
        pos, value = known["pos"].to_numpy(), known["value"].to_numpy()
        order = np.argsort(pos, kind="stable")
        pos, value = pos[order], value[order]
        # The first position has a row in any case, so that zeros before the others are some position's.
        at, found = [np.array([first])], [np.zeros(1)]
        for start in range(first, end, chunk):
            size = min(chunk, end - start)
            mine = slice(*np.searchsorted(pos, (start - reach, start + size + reach)))
            if mine.start == mine.stop:
                continue
            values = np.zeros(size + 2 * reach)
            values[pos[mine] - start + reach] = value[mine]
            made = np.convolve(values, weights, "valid")
            some = np.flatnonzero(made)
            at.append(start + some)
            found.append(made[some])
        at, found = np.concatenate(at), np.concatenate(found)
        if len(at) > 1 and at[1] == first:
            at, found = at[1:], found[1:]
        fixed = [pa.array([table[c][0].as_py()], table.schema.field(c).type).take(pa.array(np.zeros(len(at), np.int64))) for c in KEY]
        return pa.table([*fixed, pa.array(at), pa.array(np.append(at[1:], end) - 1), pa.array(found)], names=[*KEY, "at", "until", "value"])

    both = parts.select("sample", "chrom", "length", "part", "pos", "value").unionByName(empty)
    ranges = both.groupBy("sample", "chrom", "part").applyInArrow(run, "sample string, chrom string, at long, until long, value double")
    spread = ranges.select(*KEY, F.explode(F.sequence("at", "until")).alias("pos"), "at", "value")
    return spread.select(*KEY, "pos", F.when(F.col("pos") == F.col("at"), F.col("value")).otherwise(0.0).alias("value"))


def smoothed_sums(track: DataFrame, chroms: DataFrame, sigma: float, binning: int, circular: bool = True) -> DataFrame:
    """(sample, chrom, bin, total): sums over bins of what smooth() gives, without a row for each position.

    A value adds to a bin its weights of all positions there, a difference of two sums of the filter.
    """
    weights = _gaussian(sigma)
    reach = len(weights) // 2
    upto = F.array(*[F.lit(float(x)) for x in np.concatenate([[0.0], np.cumsum(weights)])])
    first, last = F.greatest(F.col("pos") - reach, F.lit(0)), F.least(F.col("pos") + reach, F.col("length") - 1)
    spread = _around(track, chroms, reach, circular).where("value <> 0").withColumn("bin", F.explode(F.sequence(F.floor(first / binning), F.floor(last / binning))))
    at = lambda x: F.element_at(upto, (x - F.col("pos") + reach + 1).cast("int"))
    share = at(F.least(last, F.col("bin") * binning + binning - 1) + 1) - at(F.greatest(first, F.col("bin") * binning))
    return spread.groupBy(*KEY, "bin").agg(F.sum(F.col("value") * share).alias("total"))


def bin_track(track: DataFrame, binning: int) -> DataFrame:
    """(sample, chrom, bin, value): means of the known positions of each bin."""
    return track.groupBy(*KEY, F.floor(F.col("pos") / binning).alias("bin")).agg(F.avg("value").alias("value"))


def zscore(track: DataFrame, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Values less the whole vector's mean, over its standard deviation; null if that is 0."""
    stats = track.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    joined = track.join(stats, list(by))
    return joined.withColumn("value", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def extract_track(track: DataFrame, chroms: DataFrame, binning: int, circular: bool = True, sigma: float | None = None, ztransform: bool = False, subset: list[str] | None = None) -> DataFrame:
    """(sample, chrom, bin, place, value): a binned track of the chosen chromosomes (ord, chrom, length); place counts bins over all of them.

    Missing positions are zeros; smoothed and standardised if asked for.
    """
    from .maps import chrom_offsets

    chosen = chroms if subset is None else chroms.where(F.col("chrom").isin(subset))
    if sigma is not None:
        sums = smoothed_sums(track, chosen, sigma, binning, circular)
    else:
        rows = fill_missing(track).join(chosen.select("chrom"), "chrom")
        sums = rows.groupBy(*KEY, F.floor(F.col("pos") / binning).alias("bin")).agg(F.sum("value").alias("total"))
    grid = track.select("sample").distinct().join(chosen.select("chrom", "length"))
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / binning))))
    size = F.least(F.lit(binning).cast("long"), F.col("length") - F.col("bin") * binning)
    binned = grid.join(sums, [*KEY, "bin"], "left").select(*KEY, "bin", (F.coalesce("total", F.lit(0.0)) / size).alias("value"))
    binned = zscore(binned) if ztransform else binned
    offsets = chrom_offsets(chosen, binning)
    return binned.join(offsets, "chrom").select(*KEY, "bin", (F.col("offset") / binning + F.col("bin")).cast("long").alias("place"), "value")


def remove_nmad(track: DataFrame, n: float = 3) -> DataFrame:
    """The track with values farther than n MADs from the median set to null, in place."""
    joined = track.join(mad(track, "value"), list(KEY))
    # A value just n MADs away stays, whatever the last digit of a mean or of a difference.
    slack = 1e-12 * F.greatest(F.abs("value"), F.abs("median"))
    return joined.withColumn("value", F.when(F.abs(F.col("value") - F.col("median")) <= n * F.col("mad") + slack, F.col("value"))).drop("median", "mad")


def interpolate_nmad(track: DataFrame, n: float = 3, order: str = "pos") -> DataFrame:
    """The track with values farther than n MADs from the median on the line between their neighbours; after the last good one, as that.

    The first value is at last set to the second one.
    """
    w = Window.partitionBy(*KEY).orderBy(order)
    good = remove_nmad(track, n)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(order).alias("p"), F.col("value").alias("v")))
    rows = good.withColumn("k", known)
    # Backwards, since a frame that ends with the last row is summed anew for each row.
    back = Window.partitionBy(*KEY).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last("k", ignorenulls=True).over(back))
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col(order) - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    rows = rows.withColumn("value", F.coalesce("value", line, F.col("a.v"))).drop("k", "a", "b")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("value").over(w))
    return rows.withColumn("value", F.when(F.col("rank") == 1, F.coalesce("next", "value")).otherwise(F.col("value"))).drop("rank", "next")


def track_window(track: DataFrame, positions: DataFrame, chroms: DataFrame, wind: int, circular: bool = True) -> DataFrame:
    """(sample, chrom, coord, offset, value): the values from coord - wind / 2 to coord + wind / 2, exclusive, round the circle or cut at the ends.

    positions is (chrom, coord), sites to look at; values meet them by a coarse grid of windows, not each with each.
    """
    half = wind // 2
    size = max(wind, 1)
    sites = positions.join(chroms.select("chrom", "length"), "chrom")
    shifts = F.array(-F.col("length"), F.lit(0).cast("long"), F.col("length")) if circular else F.array(F.lit(0).cast("long"))
    around = sites.withColumn("at", F.explode(shifts)).withColumn("at", F.col("coord") + F.col("at"))
    cells = around.withColumn("cell", F.explode(F.sequence(F.floor((F.col("at") - half) / size), F.floor((F.col("at") + half) / size))))
    rows = track.withColumn("cell", F.floor(F.col("pos") / size))
    hit = rows.join(cells, ["chrom", "cell"]).where((F.col("pos") >= F.col("at") - half) & (F.col("pos") < F.col("at") + half))
    return hit.select("sample", "chrom", "coord", (F.col("pos") - F.col("at")).alias("offset"), "value")
