"""Origin and terminus of replication from skew, sites and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, circular_distance, middle, ratio, signed_offset
from .tracks import interpolate_nmad, remove_nmad, track_window


def interval_center(intervals: DataFrame, chroms: DataFrame, circular: bool = True) -> DataFrame:
    """(chrom, center): the mean of intervals' middles, whole part; null chromosomes have none.

    On a circle also the mean with the middles of the first half moved behind the end is tried; the one whose distances sum to less
    is taken, of equal ones the plain one.
    """
    rows = intervals.join(chroms.select("chrom", "length"), "chrom").withColumn("a", middle(F.col("start"), F.col("end")))
    rows = rows.withColumn("b", F.when(F.col("a") > F.floor(F.col("length") / 2), F.col("a")).otherwise(F.col("a") + F.col("length")))
    means = rows.groupBy("chrom").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    far = rows.join(means, "chrom").groupBy("chrom", "length", "ma", "mb").agg(F.sum(F.abs(F.col("a") - F.col("ma"))).alias("da"), F.sum(F.abs(F.col("b") - F.col("mb"))).alias("db"))
    around = F.when(F.col("mb") < F.col("length"), F.col("mb")).otherwise(F.col("mb") - F.col("length"))
    place = F.when(F.col("da") <= F.col("db"), F.col("ma")).otherwise(around) if circular else F.col("ma")
    return far.select("chrom", place.cast("long").alias("center"))


def skew_candidates(skew: DataFrame, alpha: int = 100, circular: bool = True) -> DataFrame:
    """(chrom, pos, cost, step) of windows (chrom, start, end, val) in which the skew's sign changes and stays changed.

    The signs of the alpha windows before sum to the other sign than those of the alpha windows from here on; cost is the size of
    both sums' sum.  Chromosomes of fewer than alpha windows are skipped.
    """
    order = Window.partitionBy("chrom").orderBy("start")
    rows = skew.withColumn("i", F.row_number().over(order) - 1).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("chrom"))).where(F.col("count") >= alpha)
    firsts = skew.groupBy("chrom").agg(F.min("start").alias("s0"), F.min(F.struct("start", "end")).alias("w0"))
    second = skew.join(firsts, "chrom").where(F.col("start") > F.col("s0")).groupBy("chrom", "s0", "w0").agg(F.min("start").alias("s1"))
    rows = rows.join(second, "chrom")
    shifts = F.array(-F.col("count"), F.lit(0).cast("long"), F.col("count")) if circular else F.array(F.lit(0).cast("long"))
    sign = F.signum(F.round("val", 12))
    around = rows.withColumn("k", F.explode(shifts)).withColumn("k", F.col("i") + F.col("k")).where((F.col("k") >= -alpha) & (F.col("k") < F.col("count") + alpha)).withColumn("sign", sign)
    w = Window.partitionBy("chrom").orderBy("k")
    around = around.withColumn("before", F.lag("val").over(w)).withColumn("a", F.coalesce(F.sum("sign").over(w.rowsBetween(-alpha, -1)), F.lit(0.0))).withColumn("b", F.coalesce(F.sum("sign").over(w.rowsBetween(0, alpha - 1)), F.lit(0.0)))
    own = around.where("k >= 0 and k < count and before * val < 0 and a * b < 0")
    window = F.col("w0.end") - F.col("w0.start") + 1
    return own.select("chrom", (F.col("start") + F.floor(window / 2) - 1).alias("pos"), F.abs(F.col("a") + F.col("b")).alias("cost"), (F.col("s1") - F.col("s0")).alias("step"))


def gc_skew_shifts(skew: DataFrame, alpha: int = 100, circular: bool = True) -> DataFrame:
    """(chrom, coord): shifts of the skew's sign.

    Of candidates in order, one farther than alpha steps from the best one so far starts a new shift; else the cheaper stays.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos")
        found, best, cost = [], -1, float(2 * alpha + 1)
        for pos, c, step in zip(rows["pos"], rows["cost"], rows["step"], strict=True):
            if best != -1 and pos > best + alpha * step:
                found.append(best)
                best, cost = pos, c
            if c < cost:
                best, cost = pos, c
        found += [best] if best != -1 else []
        return pd.DataFrame({"chrom": np.array([rows["chrom"].iloc[0]] * len(found), object), "coord": np.array(found, np.int64)})

    return skew_candidates(skew, alpha, circular).groupBy("chrom").applyInPandas(merge, "chrom string, coord long")


def coverage_ori_ter(coverage: DataFrame, chroms: DataFrame, cov_binning: int) -> DataFrame:
    """(sample, chrom, ori, ter) from coverage tracks, by chromosomes of more than 50 bins with any signal.

    Bins are freed of outliers, scaled to 0 to 1 and smoothed twice by a moving mean round the circle, widened until one peak and one
    trough are left; the higher is the origin.  If that never happens, 0 and half the length.
    """
    rows = coverage.join(chroms.select("chrom", "length"), "chrom")
    binned = rows.groupBy(*KEY, "length", F.floor(F.col("pos") / cov_binning).alias("bin")).agg(F.avg("value").alias("value"))
    clean = interpolate_nmad(binned.withColumn("value", F.coalesce("value", F.lit(0.0))), order="bin")

    def extremes(v: np.ndarray) -> list[int]:
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        ends = np.concatenate([starts[1:], [len(v)]]) - 1
        u = v[starts]
        mid = (starts + ends) // 2
        return [int(mid[k]) for k in range(1, len(u) - 1) if u[k] > u[k - 1] and u[k] > u[k + 1]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["length"].iloc[0])
        v = pdf.sort_values("bin")["value"].to_numpy(float)
        v = v - v.min()
        if len(v) <= 50 or v.max() <= 0:
            return pd.DataFrame({"sample": np.array([], object), "chrom": np.array([], object), "ori": np.array([], np.int64), "ter": np.array([], np.int64)})
        v = v / v.max()
        ori, ter = 0, length // 2
        for width in range(3, len(v) // 2 + 1, 2):
            smooth = v
            for _ in range(2):
                running = np.cumsum(np.concatenate([[0.0], smooth[-(width // 2) :], smooth, smooth[: width // 2]]))
                smooth = (running[width:] - running[:-width]) / width
            smooth = smooth.round(12)
            high, low = extremes(smooth), extremes(-smooth)
            if len(high) == 1 and len(low) == 1:
                ori, ter = high[0] * cov_binning, low[0] * cov_binning
                break
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "chrom": [pdf["chrom"].iloc[0]], "ori": [ori], "ter": [ter]})

    return clean.groupBy(*KEY).applyInPandas(run, "sample string, chrom string, ori long, ter long")


def detect_ori_ter(shifts: DataFrame, pars: DataFrame, mats: DataFrame, chroms: DataFrame, coverage: DataFrame | None = None, cov_binning: int = 5000, circular: bool = True) -> DataFrame:
    """(chrom, ori, ter) of all chromosomes (chrom, length).

    More than 10 matS sites: the terminus is their center, the origin opposite; else any parS sites: the origin is their center; else
    coverage.  Both then move to the nearest skew shift of the chromosome, round the circle; of equally near ones the first.  Null
    where nothing tells, where fewer than 2 shifts are known in all, or none on the chromosome.
    """
    m = interval_center(mats, chroms, circular).withColumnRenamed("center", "mat")
    counts = mats.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_mats"))
    p = interval_center(pars, chroms, circular).withColumnRenamed("center", "par")
    rows = chroms.select("chrom", "length").join(m, "chrom", "left").join(counts, "chrom", "left").join(p, "chrom", "left")
    if coverage is not None:
        c = coverage_ori_ter(coverage, chroms, cov_binning).groupBy("chrom").agg(F.min(F.struct("sample", "ori", "ter")).alias("c"))
        rows = rows.join(c.select("chrom", F.col("c.ori").alias("cov_ori"), F.col("c.ter").alias("cov_ter")), "chrom", "left")
    else:
        rows = rows.withColumns({"cov_ori": F.lit(None).cast("long"), "cov_ter": F.lit(None).cast("long")})
    opposite = lambda x: F.when(x + F.col("length") / 2 > F.col("length"), x - F.col("length") / 2).otherwise(x + F.col("length") / 2)
    by_mats = F.col("n_mats") > 10
    rows = rows.withColumn("guess_ori", F.when(by_mats, opposite(F.col("mat"))).when(F.col("par").isNotNull(), F.col("par")).otherwise(F.col("cov_ori")))
    rows = rows.withColumn("guess_ter", F.when(by_mats, F.col("mat")).when(F.col("par").isNotNull(), opposite(F.col("par"))).otherwise(F.col("cov_ter")))
    total = shifts.agg(F.count(F.lit(1)).alias("n_shifts"))
    near = rows.join(shifts.select("chrom", "coord"), "chrom").join(total).where("n_shifts > 1 and guess_ori is not null")
    best = lambda guess: F.min(F.struct(circular_distance(F.col("coord").cast("double"), F.col(guess).cast("double"), F.col("length")), "coord"))["coord"]
    found = near.groupBy("chrom").agg(best("guess_ori").alias("ori"), best("guess_ter").alias("ter"))
    return chroms.select("chrom").join(found, "chrom", "left").select("chrom", "ori", "ter")


def oriter_ratio(track: DataFrame, positions: DataFrame, chroms: DataFrame, window: int = 100_000, circular: bool = True) -> DataFrame:
    """(sample, chrom, ori, ter, ratio): mean coverage, outliers left out, in a window round each chromosome's Ori and Ter (chrom, ori, ter)."""
    kind = F.explode(F.array(F.struct(F.lit("ori").alias("kind"), F.col("ori").alias("coord")), F.struct(F.lit("ter").alias("kind"), F.col("ter").alias("coord"))))
    sites = positions.select("chrom", kind.alias("s")).select("chrom", "s.kind", "s.coord").where("coord is not null")
    values = track_window(remove_nmad(track), sites.select("chrom", "coord").distinct(), chroms, window, circular)
    joined = values.join(sites, ["chrom", "coord"])
    means = joined.groupBy(*KEY).agg(F.avg(F.when(F.col("kind") == "ori", F.col("value"))).alias("ori"), F.avg(F.when(F.col("kind") == "ter", F.col("value"))).alias("ter"))
    # A track without a value in either window has a row too.
    every = track.select(*KEY).distinct().join(sites.select("chrom").distinct(), "chrom", "left_semi")
    return every.join(means, list(KEY), "left").withColumn("ratio", ratio(F.col("ori"), F.col("ter")))


def recenter(scores: DataFrame, origins: DataFrame, binning: int) -> DataFrame:
    """(sample, chrom, bin, x, score): scores with the origin (chrom, ori) at 0 and x from -half to half the chromosome, in base pairs."""
    joined = scores.join(origins.select("chrom", "ori"), "chrom")
    at = signed_offset(F.col("bin"), F.floor(F.col("ori") / binning), F.col("n"))
    return joined.select(*KEY, "bin", (at * binning).alias("x"), "score")


def site_offsets(sites: DataFrame, origins: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chrom, coord, offset): the shorter way round the circle from the origin to each site."""
    joined = sites.join(origins.select("chrom", "ori"), "chrom").join(chroms.select("chrom", "length"), "chrom")
    return joined.select("chrom", "coord", signed_offset(F.col("coord"), F.col("ori"), F.col("length")).alias("offset"))
