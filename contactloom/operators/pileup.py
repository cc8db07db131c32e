"""Pileups: windows of maps and tracks round genes, stacked.

Windows are long: (sample, chrom, gene_id, di, dj, value), di and dj from -w to w.  Only stored cells and masked or missing ones have a
row; all others of a window are zeros, which the stack counts without writing them out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY
from ..plans.lineage import cut
from .maps import unmasked

#: Neighbours of a gene that random controls draw.
DRAWS = 10


def feature_windows(features: DataFrame, chroms: DataFrame, binning: int, window: int, circular: bool = True, track: bool = False) -> DataFrame:
    """(sample, chrom, gene_id, n, turned, at): the first bin of each feature's window, before it is turned round a circle; null where there is no window.

    features is (sample, chrom, gene_id, tss, strand), chroms (chrom, length).  Maps are centred on round(tss / binning - half a bin), half
    to even, tracks on the bin of the tss; windows of the reverse strand are turned round.  A circle has its whole bins only, n; a
    chromosome shorter than the window has none.
    """
    w = window // binning
    start = F.floor(F.col("tss") / binning) - w if track else F.bround((F.col("tss") - window) / binning - F.lit(0.5)).cast("long")
    rows = features.join(chroms.select("chrom", "length"), "chrom")
    n = F.floor(F.col("length") / binning)
    enough = (n >= 2 * w + 1) if track else (F.col("length") >= 2 * window + binning)
    bins = n if circular else F.ceil(F.col("length") / binning)
    return rows.select(*KEY, "gene_id", bins.alias("n"), F.coalesce(F.col("strand") == "-", F.lit(False)).alias("turned"), F.when(enough, start).alias("at"))


def of_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """The rows of the samples that have features: windows look at no others, whose maps need neither be made nor masked.

    A filter by names, which goes below the sums that make the maps, as a join would not.
    """
    names = [r.sample for r in features.select("sample").distinct().collect()]  # a row for each sample
    return rows.where(F.col("sample").isin(names))


def _bin_at(k: Column, circular: bool) -> Column:
    """The bin at place k of a window, null where there is none."""
    b = F.col("at") + k
    return F.pmod(b, F.col("n")) if circular else F.when((b >= 0) & (b < F.col("n")), b)


def feature_bins(features: DataFrame, chroms: DataFrame, binning: int, window: int, circular: bool = True, track: bool = False) -> DataFrame:
    """(sample, chrom, gene_id, d, bin): the bin at each place d of each feature's window, as feature_windows has it; null where there is none."""
    w = window // binning
    rows = feature_windows(features, chroms, binning, window, circular, track).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * w))))
    d = F.when(F.col("turned"), w - F.col("k")).otherwise(F.col("k") - w)
    return rows.select(*KEY, "gene_id", d.cast("long").alias("d"), _bin_at(F.col("k"), circular).cast("long").alias("bin"))


def meet_tiles(cells: DataFrame, windows: DataFrame, w: int, circular: bool = True) -> DataFrame:
    """Windows of feature_windows() joined with the cells of all tiles that they touch.

    Tiles have w x w cells, so that a window touches three along each axis, or four where the circle closes, and what it meets is 2.25
    times its size, however large the map is.
    """
    size = max(w, 1)
    tile = lambda b: F.floor(b / size).cast("long")
    touched = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2 * w)), lambda k: tile(_bin_at(k, circular))))
    wanted = windows.where("at is not null").withColumn("tiles", F.filter(touched, lambda t: t.isNotNull()))
    wanted = wanted.withColumn("tile1", F.explode("tiles")).withColumn("tile2", F.explode("tiles")).drop("tiles")
    keyed = cells.select(*KEY, tile(F.col("bin1")).alias("tile1"), tile(F.col("bin2")).alias("tile2"), "bin1", "bin2", "value")
    return wanted.join(keyed, [*KEY, "tile1", "tile2"])


def extract_windows(cells: DataFrame, bins: DataFrame, features: DataFrame, chroms: DataFrame, binning: int, window: int, circular: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sample, chrom, gene_id, di, dj, value) of the stored cells of whole maps in each feature's window, and (sample, chrom, gene_id, d) of its
    places that are masked or off the map, whose rows and columns are unknown.

    Cells farther from the diagonal than windows reach are left out first; the others meet windows by tiles, and their places follow from
    the window's first bin.
    """
    w = window // binning
    apart = F.abs(F.col("bin1") - F.col("bin2"))
    near = cells.where((apart <= 2 * w) | (F.col("n") - apart <= 2 * w) if circular else apart <= 2 * w)
    met = meet_tiles(unmasked(near, bins), feature_windows(features, chroms, binning, window, circular), w, circular)
    k = lambda b: F.pmod(F.col(b) - F.col("at"), F.col("n")) if circular else F.col(b) - F.col("at")
    inside = met.withColumns({"i": k("bin1"), "j": k("bin2")}).where(f"i between 0 and {2 * w} and j between 0 and {2 * w}")
    place = lambda c: F.when(F.col("turned"), w - F.col(c)).otherwise(F.col(c) - w).cast("long")
    held = inside.select(*KEY, "gene_id", place("i").alias("di"), place("j").alias("dj"), "value")
    good = bins.where("not masked").select(*KEY, "bin")
    places = feature_bins(features, chroms, binning, window, circular)
    return held, places.join(good, [*KEY, "bin"], "left_anti").select(*KEY, "gene_id", "d")


def extract_track_windows(track: DataFrame, features: DataFrame, chroms: DataFrame, binning: int, window: int, circular: bool = True) -> DataFrame:
    """(sample, chrom, gene_id, d, value): a binned track (sample, chrom, bin, value) at each place of each feature's window; null off it, 0 where
    the track has no value."""
    places = feature_bins(features, chroms, binning, window, circular, track=True)
    joined = places.join(track.select(*KEY, "bin", "value"), [*KEY, "bin"], "left")
    return joined.select(*KEY, "gene_id", "d", F.when(F.col("bin").isNotNull(), F.coalesce("value", F.lit(0.0))).alias("value"))


def transcribed(genes: DataFrame, threshold: float) -> DataFrame:
    """Genes with `high`: whether the rpkm reaches the (100 - threshold)-th percentile of the sample's."""
    limit = genes.groupBy("sample").agg(F.percentile("rpkm", F.lit(1 - threshold / 100)).alias("cut"))
    return genes.join(limit, "sample").withColumn("high", F.col("rpkm") >= F.col("cut")).drop("cut")


def tu_heads(genes: DataFrame, tu_length: int) -> DataFrame:
    """The first genes of transcription units among the transcribed ones of each chromosome.

    A forward gene goes if the one before is forward and within tu_length; a reverse gene if the one after is reverse and within it.
    """
    w = Window.partitionBy(*KEY).orderBy("tss", "gene_id")
    rows = genes.withColumns({"_ps": F.lag("strand").over(w), "_pt": F.lag("tss").over(w), "_ns": F.lead("strand").over(w), "_nt": F.lead("tss").over(w)})
    forward = F.coalesce((F.col("_ps") == "+") & (F.col("tss") - F.col("_pt") <= tu_length), F.lit(False))
    reverse = F.coalesce((F.col("_ns") == "-") & (F.col("_nt") - F.col("tss") <= tu_length), F.lit(False))
    return rows.where(F.when(F.col("strand") == "-", ~reverse).otherwise(~forward)).drop("_ps", "_pt", "_ns", "_nt")


def control_features(heads: DataFrame, genes: DataFrame, chroms: DataFrame, mode: str, window: int, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """Features to compare with: the genes that are not transcribed, or `random-neighbor`: `draws` places near each head, by a seeded hash.

    A neighbour lies within the window of its gene; near an end of the chromosome, within two windows of that end.  It is named by its
    gene, a stroke and its number.
    """
    if mode == "non-transcribed":
        return genes.where("not high")
    if mode != "random-neighbor":
        raise ValueError(mode)
    rows = heads.join(chroms.select("chrom", "length"), "chrom").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    lo = F.when(F.col("tss") < window, F.lit(0)).when(F.col("tss") + window > F.col("length"), F.col("length") - 2 * window).otherwise(F.col("tss") - window)
    hi = F.when(F.col("tss") < window, F.col("tss") + 2 * window).when(F.col("tss") + window > F.col("length"), F.col("length")).otherwise(F.col("tss") + window)
    name = F.concat_ws("/", F.col("gene_id").cast("string"), F.col("draw").cast("string"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("/", "sample", "chrom", name, F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.withColumn("tss", lo + hashed % (hi - lo + 1)).withColumn("gene_id", name).drop("length", "draw")


def unknown_counts(gone: DataFrame) -> DataFrame:
    """(sample, di, dj, unknown): how many features' windows do not know a cell, as its row or its column is gone."""
    by = ["sample", "chrom", "gene_id"]
    one = F.count(F.lit(1)).alias("k")
    lost = gone.groupBy("sample", "d").agg(one)
    wide = lambda here, other: lost.select("sample", F.col("d").alias(here), F.lit(None).cast("long").alias(other), F.col("k").alias("unknown"))
    both = gone.withColumnRenamed("d", "di").join(gone.withColumnRenamed("d", "dj"), by).groupBy("sample", "di", "dj").agg(one)
    rows = wide("di", "dj").unionByName(wide("dj", "di"))
    return rows.unionByName(both.select("sample", "di", "dj", (-F.col("k")).alias("unknown")))


def mean_over_draws(held: DataFrame, gone: DataFrame, draws: int = DRAWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of control_features' neighbours as one window for each gene: means over its draws, unknown cells left out.

    Gives the cells that are not zero, the places that no draw knows, and single cells (sample, chrom, gene_id, di, dj) that none does.
    """
    gene = F.regexp_replace("gene_id", "/[0-9]+$", "").alias("gene_id")
    key = [*KEY, "gene_id"]
    sums = held.select(*KEY, gene, "di", "dj", "value").groupBy(*key, "di", "dj").agg(F.sum("value").alias("total"))
    lost = gone.select(*KEY, gene, "d").groupBy(*key, "d").agg(F.count(F.lit(1)).alias("k"))
    pair = gone.withColumnRenamed("d", "di").join(gone.withColumnRenamed("d", "dj"), key)
    both = pair.select(*KEY, gene, "di", "dj").groupBy(*key, "di", "dj").agg(F.count(F.lit(1)).alias("both"))
    rows, columns = lost.withColumnsRenamed({"d": "di", "k": "rows"}), lost.withColumnsRenamed({"d": "dj", "k": "columns"})
    joined = sums.join(rows, [*key, "di"], "left").join(columns, [*key, "dj"], "left").join(both, [*key, "di", "dj"], "left").na.fill(0, ["rows", "columns", "both"])
    means = joined.select(*key, "di", "dj", (F.col("total") / (draws - F.col("rows") - F.col("columns") + F.col("both"))).alias("value"))
    some = lost.where(F.col("k") < draws)
    crossed = some.withColumnsRenamed({"d": "di", "k": "rows"}).join(some.withColumnsRenamed({"d": "dj", "k": "columns"}), key).join(both, [*key, "di", "dj"], "left").na.fill(0, ["both"])
    cells = crossed.where(F.col("rows") + F.col("columns") - F.col("both") >= draws).select(*key, "di", "dj")
    return means, lost.where(F.col("k") >= draws).select(*key, "d"), cells


def pileup(held: DataFrame, gone: DataFrame, features: DataFrame, w: int, operation: str = "mean", cells: DataFrame | None = None) -> DataFrame:
    """(sample, di, dj, value): means or medians over the features of their windows' cells, unknown ones left out, zeros counted.

    A cell's number of zeros is that of features less those with a stored or unknown cell there; `cells` names unknown cells beside
    those in lost rows and columns.
    """
    count = features.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    place = F.sequence(F.lit(-w).cast("long"), F.lit(w).cast("long"))
    grid = count.withColumn("di", F.explode(place)).withColumn("dj", F.explode(place))
    lost = unknown_counts(gone)
    if cells is not None:
        lost = lost.unionByName(cells.groupBy("sample", "di", "dj").agg(F.count(F.lit(1)).alias("unknown")))
    # A lost row or column counts in all of its cells.
    spread = lambda c: F.when(F.col(c).isNull(), place).otherwise(F.array(c))
    lost = lost.withColumn("i", F.explode(spread("di"))).withColumn("j", F.explode(spread("dj"))).groupBy("sample", F.col("i").alias("di"), F.col("j").alias("dj")).agg(F.sum("unknown").alias("unknown"))
    grid = grid.join(lost, ["sample", "di", "dj"], "left").na.fill(0, ["unknown"])
    grid = grid.withColumn("known", F.col("n") - F.col("unknown"))
    if operation == "mean":
        sums = held.groupBy("sample", "di", "dj").agg(F.sum("value").alias("total"))
        joined = grid.join(sums, ["sample", "di", "dj"], "left")
        return joined.select("sample", "di", "dj", F.when(F.col("known") > 0, F.coalesce("total", F.lit(0.0)) / F.col("known")).alias("value"))
    stored = held.groupBy("sample", "di", "dj").agg(F.count(F.lit(1)).alias("k"))
    zeros = grid.join(stored, ["sample", "di", "dj"], "left").select("sample", "di", "dj", F.lit(0.0).alias("value"), (F.col("known") - F.coalesce("k", F.lit(0))).alias("times"))
    rows = held.select("sample", "di", "dj", "value", F.lit(1).cast("long").alias("times")).unionByName(zeros.where("times > 0"))
    medians = rows.groupBy("sample", "di", "dj").agg(F.percentile(F.col("value"), F.lit(0.5), F.col("times")).alias("value"))
    return grid.select("sample", "di", "dj").join(medians, ["sample", "di", "dj"], "left")


def track_pileup(windows: DataFrame, operation: str = "mean") -> DataFrame:
    """(sample, d, value): means or medians of track windows, unknown values left out."""
    fold = F.avg("value") if operation == "mean" else F.percentile("value", F.lit(0.5))
    return windows.groupBy("sample", "d").agg(fold.alias("value"))


class Pileups(NamedTuple):
    """Pileups of maps (sample, di, dj, value) and of a track (sample, d, value), of heads and of their controls; None where there is none."""

    heads: DataFrame
    controls: DataFrame | None
    track_heads: DataFrame | None
    track_controls: DataFrame | None


def pileup_genes(cells: DataFrame, bins: DataFrame, genes: DataFrame, chroms: DataFrame, binning: int, window: int, threshold: float = 10, tu_length: int = 3000, mode: str = "non-transcribed", operation: str = "mean", circular: bool = True, track: DataFrame | None = None, seed: int = 0) -> Pileups:
    """Pileups of the heads of transcription units and of their controls, of maps and, if given, of a binned track (sample, chrom, bin, value).

    Controls are the genes that are not transcribed; with `random-neighbor` DRAWS neighbours of each head, whose mean stands for it;
    with `detrend`, for maps that are detrended already, none, and each place of the track is compared with the whole track's
    mean or median.
    """
    w = window // binning
    ranked = transcribed(genes, threshold)
    heads = tu_heads(ranked.where("high"), tu_length)
    windows = lambda f: extract_windows(cells, bins, f, chroms, binning, window, circular)
    stack = lambda f: pileup(*windows(f), f, w, operation)
    along = lambda f: extract_track_windows(track, f, chroms, binning, window, circular)
    own = track_pileup(along(heads), operation) if track is not None else None
    if mode == "detrend":
        if track is None:
            return Pileups(stack(heads), None, None, None)
        level = track.groupBy("sample").agg((F.avg("value") if operation == "mean" else F.percentile("value", F.lit(0.5))).alias("value"))
        return Pileups(stack(heads), None, own, own.select("sample", "d").join(level, "sample"))
    controls = control_features(heads, ranked, chroms, mode, window, seed)
    if mode == "non-transcribed":
        return Pileups(stack(heads), stack(controls), own, track_pileup(along(controls), operation) if track is not None else None)
    controls = cut(controls)
    held, gone, unknown = mean_over_draws(*map(cut, windows(controls)))
    other = None
    if track is not None:
        gene = F.regexp_replace("gene_id", "/[0-9]+$", "").alias("gene_id")
        other = track_pileup(along(controls).groupBy(*KEY, gene, "d").agg(F.avg("value").alias("value")), operation)
    return Pileups(stack(heads), pileup(held, gone, heads, w, operation, unknown), own, other)


def pileup_contrast(pos: DataFrame, neg: DataFrame | None, ratio: bool = False, window: int | None = None) -> DataFrame:
    """(sample, di, dj, value): pos - neg, or with `ratio` log10 of pos less log10 of neg (null unless both are above 0), within `window` bins.

    Without neg it is pos itself.
    """
    near = pos if window is None else pos.where((F.abs("di") <= window) & (F.abs("dj") <= window))
    if neg is None:
        return near.select("sample", "di", "dj", "value")
    both = near.join(neg.withColumnRenamed("value", "neg"), ["sample", "di", "dj"])
    log = lambda c: F.log10(F.when(F.col(c) > 0, F.col(c)))
    value = log("value") - log("neg") if ratio else F.col("value") - F.col("neg")
    return both.select("sample", "di", "dj", value.alias("value"))


def track_contrast(pos: DataFrame, neg: DataFrame, window: int | None = None) -> DataFrame:
    """(sample, d, value): the difference of two track pileups, within `window` bins."""
    both = pos.join(neg.withColumnRenamed("value", "neg"), ["sample", "d"])
    near = both if window is None else both.where(F.abs("d") <= window)
    return near.select("sample", "d", (F.col("value") - F.col("neg")).alias("value"))
