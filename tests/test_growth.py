"""Steps whose work once grew faster than their input, and results that had missed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.operators import balance, correlation, edits, maps, oriter, signals, similarity, tracks
from contactloom.plans.lineage import cut

MAP = "sample string, chrom string, n long, bin1 long, bin2 long, value double"


def random_map(spark, n, seed, samples=("s",), share=0.1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in samples:
        m = np.triu(rng.poisson(4, (n, n)) + 1) * (rng.random((n, n)) < share)
        m[[3, 9, 10]] = m[:, [3, 9, 10]] = 0
        rows += [(s, "c", n, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, MAP)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("f", [lambda df: signals.local_score(df), lambda df: tracks.interpolate_nmad(df.withColumnRenamed("score", "value"), order="bin")])
def test_no_frame_is_summed_anew_for_each_row(spark, f):
    scores = spark.range(400).select(F.lit("s").alias("sample"), F.lit("c").alias("chrom"), F.lit(400).cast("long").alias("n"), F.col("id").alias("bin"), (F.xxhash64("id") % 50 / 7.0).alias("score"))
    assert "currentrow$(), unboundedfollowing$()" not in plan(f(scores))


@pytest.mark.parametrize("block, side", [(7, 2), (4096, 512)])
def test_strata_are_products_of_matrices(spark, block, side):
    names = ("p", "q", "r", "s", "t")
    cells = random_map(spark, 40, 5, names, 0.4).where("bin2 - bin1 between 0 and 4 and (sample <> 't' or bin1 = bin2)")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if (a < b) != (a == "r")], "sample_a string, sample_b string")
    made = similarity.strata(cells, pairs, (), block, side)
    assert "flatmapgroupsinarrow" in plan(made)
    got = {(r.sample_a, r.sample_b, r.d): (r.cells, r.r1, r.r2) for r in made.collect()}
    grid = {(r.sample, r.bin2 - r.bin1, r.bin1): r.value for r in cells.collect()}
    want = {}
    for a, b in pairs.collect():
        for d in range(5):
            at = sorted({k[2] for k in grid if k[0] in (a, b) and k[1] == d})
            if at:
                x, y = (np.array([grid.get((s, d, k), 0.0) for k in at]) for s in (a, b))
                want[a, b, d] = (len(at), np.mean(x * y) - x.mean() * y.mean(), np.sqrt(x.var() * y.var()))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_bins_of_maps_are_not_broadcast(spark):
    cells = spark.createDataFrame([("s", "c", 50_000, 1, 2, 1.0)], MAP)
    totals = spark.range(300_000).select(F.lit("s").alias("sample"), F.lit("c").alias("chrom"), F.col("id").alias("bin"), F.lit(1).alias("t"))
    made = maps.all_bins(cells).join(totals, ["sample", "chrom", "bin"])
    assert "sortmergejoin" in plan(made) and "broadcast" not in plan(made)
    assert made.count() == 50_000


def test_white_lines_are_filled_from_stored_cells(spark):
    cells = cut(maps.from_upper(random_map(spark, 60, 2)))
    bins = cut(maps.all_bins(cells).withColumn("masked", F.col("bin").isin(3, 9, 10, 30)))
    made = maps.interpolate_white_lines(cells, bins)
    # Lines are not joined with all bins, whose distinct pairs would be the cells that are looked at.
    assert "functions=[])" not in plan(made)
    m = np.zeros((60, 60))
    for r in cells.collect():
        m[r.bin1, r.bin2] = r.value
    bad = np.isin(np.arange(60), [3, 9, 10, 30])
    gone = bad[:, None] | bad[None, :]
    want = np.where(gone, 0.0, m)
    for i in range(2, 58):
        for j in range(2, 58):
            if {i, j} & {3, 30}:
                near = [m[i + d, j + d] for d in (-2, -1, 1, 2) if not gone[i + d, j + d]]
                want[i, j] = np.mean(near) if near else 0.0
    got = np.zeros((60, 60))
    for r in made.collect():
        got[r.bin1, r.bin2] += r.value
    assert np.allclose(got, want)


@pytest.mark.parametrize("n, s", [(24, 3), (24, 6), (25, 6), (13, 2)])
def test_masked_cells_of_antidiagonals_are_counted_not_written(spark, n, s):
    cells = maps.from_upper(random_map(spark, n, n, share=0.5))
    bins = maps.all_bins(cells).withColumn("masked", F.col("bin").isin(0, 3, 4, 9))
    m = np.zeros((n, n))
    for r in cells.collect():
        m[r.bin1, r.bin2] = r.value
    i, j = np.indices((n, n))
    bad = np.isin(np.arange(n), [0, 3, 4, 9])
    m[abs(i - j) < 2] = 0
    ok = ~(bad[:, None] | bad[None, :]) | (abs(i - j) < 2)
    whole = signals.antidiagonal(cells, bins, norm_percentile=None)
    part = signals.partial_antidiagonals(cells, {"s": F.lit(s)}, bins)
    assert "flatmapgroupsinarrow" in plan(whole) and "flatmapgroupsinarrow" in plan(part)
    for r in whole.collect():
        at = ((i + j) % n == r.pos % n) & ok
        assert np.isclose(r.score, m[at].mean()) if at.any() else r.score is None
    q, t = i + j, i - np.maximum(0, i + j - n + 1)
    l = n - abs(q - (n - 1))
    for r in part.collect():
        p = r.pos
        lp = n - abs(p - (n - 1))
        if p == 2 * n - 1:
            at = (q == n - 1) & ((t < s) | (t >= n - s))
        else:
            at = (q == p) & (((p != n - 1) & (lp < 2 * s)) | ((t >= l // 2 - s) & (t < l // 2 + s)))
            if p != n - 1 and lp < 2 * s:
                at |= (q == (p + n if p < n else p - n)) & ((t < s - lp // 2) | (t >= l - s + lp // 2))
        at &= ok
        assert np.isclose(r.score, m[at].mean()) if at.any() else r.score is None


def test_a_track_without_values_near_both_places_has_a_row(spark):
    track = spark.createDataFrame([("a", "c", p, 1.0) for p in range(100)] + [("b", "c", 50, 1.0)], "sample string, chrom string, pos long, value double")
    places = spark.createDataFrame([("c", 5, 80)], "chrom string, ori long, ter long")
    chroms = spark.createDataFrame([("c", 100)], "chrom string, length long")
    got = {tuple(r) for r in oriter.oriter_ratio(track, places, chroms, 10).collect()}
    assert got == {("a", "c", 1.0, 1.0, 1.0), ("b", "c", None, None, None)}


def test_many_samples_are_edited_in_one_group(spark):
    names = [f"s{k}" for k in range(300)]
    layout = spark.createDataFrame([(s, "a", 0, "a", 0, 100, False) for s in names], "sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean")
    wanted = spark.createDataFrame([(s, 0, "invert", "a", 0, 10, 20, None, None, None, False) for s in names[1:]] + [("new", 0, "insert", "b", 0, None, None, "a", 5, 9, True)], "sample string, seq int, op string, chrom string, pos long, start long, end long, src_chrom string, src_start long, src_end long, invert boolean")
    for together in (50, edits.TOGETHER):
        made = edits.apply_edits(layout, wanted, together)
        assert "pmod" in plan(made)
        got = {}
        for r in made.collect():
            got.setdefault((r.sample, r.chrom), []).append((r.ord, r.src_chrom, r.start, r.end, r.is_reverse))
        assert got.pop(("new", "b")) == [(0, "a", 5, 9, True)] and sorted(got.pop(("s0", "a"))) == [(0, "a", 0, 100, False)]
        assert len(got) == 299 and all(sorted(v) == [(0, "a", 0, 10, False), (1, "a", 10, 20, True), (2, "a", 20, 100, False)] for v in got.values())


@pytest.mark.parametrize("f, column", [(balance.balance_ice, "bias"), (balance.normalize_scn, "value")])
def test_maps_of_moderate_size_are_not_brought_to_the_driver(spark, monkeypatch, f, column):
    cells = random_map(spark, 40, 4, ("s", "t"), 0.5)
    cells = cut(cells if column == "bias" else maps.from_upper(cells))
    rows = lambda df: {tuple(r[c] for c in df.columns if c != column): r[column] for r in df.collect()}
    # The same by steps of all tasks.
    want = rows(f(cells, own_cells=0))
    monkeypatch.setattr(balance, "Held", None)
    got = rows(f(cells))
    assert got.keys() == want.keys() and sum(v is not None for v in got.values()) > 40
    assert all(got[k] == want[k] if want[k] is None else np.isclose(got[k], want[k], rtol=1e-5) for k in want)


def test_a_mean_of_twenty_is_not_below_it_by_its_last_digit(spark, monkeypatch):
    from contactloom.plans import queries

    scores = [45.0, 19.999999999999996, 45.0, 5.0, 45.0]
    frame = spark.createDataFrame([("s", "c", 5, k, x) for k, x in enumerate(scores)], "sample string, chrom string, n long, bin long, score double")
    monkeypatch.setattr(queries, "_track_scores", lambda spark, d: frame)
    assert {(r.bin, r.score) for r in queries.QUERIES["s01_find_minima_plateaus"](spark, "").collect()} == {(1, 1.0), (3, 0.0)}


@pytest.mark.parametrize("block, side", [(30, 2), (4096, 128)])
def test_training_writes_no_smoothed_cell(spark, block, side):
    names = ("p", "q", "r", "s", "t")
    upper = cut(random_map(spark, 75, 5, names, 0.1).where("bin2 - bin1 < 12 and (sample <> 't' or bin1 > 60)"))
    pairs, halves, band = similarity.sample_pairs(upper), [0, 1, 4], 3
    rows = lambda df: {(r.half, r.sample_a, r.sample_b, r.d): (r.cells, r.r1, r.r2) for r in df.collect()}
    want = rows(similarity.strata(similarity.smooth(maps.from_upper(upper), halves, band), pairs, ("half",)))
    got = rows(similarity.contact_strata(upper, pairs, halves, band, (), block, side))
    assert got.keys() == want.keys() and len(want) == 3 * 10 * 4
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("side, own_cells, room", [(128, 1 << 22, 1 << 23), (2, 1 << 22, 1), (2, 0, 1 << 23)])
def test_similarities_are_told_without_a_row_for_each_diagonal(spark, side, own_cells, room):
    names = ("p", "q", "r", "s", "t")
    upper = cut(random_map(spark, 75, 5, names, 0.1).where("bin2 - bin1 < 12 and (sample <> 't' or bin1 > 60)"))
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if (a < b) != (a == "r")], "sample_a string, sample_b string")
    halves, band = [0, 1, 4], 3
    rows = lambda df: {(r.half, r.sample_a, r.sample_b): r.scc for r in df.collect()}
    want = rows(similarity.adjusted(similarity.strata(similarity.smooth(maps.from_upper(upper), halves, band), pairs, ("half",)), by=("half",)))
    made = similarity.contact_scores(upper, pairs, halves, band, (), side, own_cells, room)
    got = rows(made)
    assert got.keys() == want.keys() and len(want) > 20 and all(np.isclose(got[k], want[k]) for k in want)


def test_contacts_are_drawn_without_arrays_of_hashes(spark):
    upper = cut(random_map(spark, 40, 6, ("a", "b"), 0.3))
    assert "lambda" not in plan(maps.subsample(upper, 100, 3))


def test_all_draws_are_one_job_and_the_same(spark):
    upper = cut(random_map(spark, 40, 6, ("a", "b"), 0.3))
    made = maps.subsamples(upper, 100, [3, 4])
    for seed in (3, 4):
        got = {tuple(r) for r in made.where(F.col("draw") == seed).drop("draw").collect()}
        assert got == {tuple(r) for r in maps.subsample(upper, 100, seed).collect()} and sum(r[-1] for r in got) == 200


@pytest.mark.parametrize("circular", [True, False])
def test_bins_of_a_smoothed_track_need_no_positions(spark, circular):
    rng = np.random.default_rng(3)
    rows = [(s, "c", int(p), float(rng.random())) for s in "ab" for p in [0, 1, 99, 102, *rng.choice(np.arange(2, 99), 30, False)]]
    track = cut(spark.createDataFrame(rows, "sample string, chrom string, pos long, value double"))
    chroms = spark.createDataFrame([(0, "c", 103)], "ord int, chrom string, length long")
    made = tracks.extract_track(track, chroms, 10, circular, sigma=3.0)
    assert "flatmapgroupsinpandas" not in plan(made)
    want = {(r.sample, r.bin): r.value for r in tracks.bin_track(tracks.smooth(track, chroms, 3.0, circular), 10).collect()}
    got = {(r.sample, r.bin): r.value for r in made.collect()}
    assert got.keys() == want.keys() and len(got) == 22 and all(np.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("circular", [True, False])
def test_zeros_of_a_smoothed_track_are_ranges_till_the_end(spark, monkeypatch, circular):
    monkeypatch.setattr(tracks, "TOGETHER", 64)
    known = {"s": {40: 1.0, 41: -2.0, 299: 3.0}, "t": {0: 5.0}, "u": {150: 0.0}}
    track = spark.createDataFrame([(s, "c", p, v) for s, at in known.items() for p, v in at.items()], "sample string, chrom string, pos long, value double")
    chroms = spark.createDataFrame([("c", 300)], "chrom string, length long")
    made = tracks.smooth(track, chroms, 2.0, circular, chunk=20)
    # Positions are written out above the task that smooths.
    told = plan(made)
    assert "explode(sequence(at" in told.split("flatmapgroupsinarrow")[0]
    weights = tracks._gaussian(2.0)
    for s, at in known.items():
        v = np.zeros(300)
        v[list(at)] = list(at.values())
        want = np.convolve(np.pad(v, len(weights) // 2, mode="wrap" if circular else "edge"), weights, "valid")
        got = {r.pos: r.value for r in made.where(F.col("sample") == s).collect()}
        assert sorted(got) == list(range(300)) and np.allclose([got[k] for k in range(300)], want)


@pytest.mark.parametrize("high, own_cells, share", [(1 << 16, 1 << 22, 0.1), (7, 1 << 22, 0.1), (1 << 16, 40, 0.02), (7, 1 << 22, 0.9)])
def test_no_product_of_two_cells_is_shuffled(spark, monkeypatch, high, own_cells, share):
    monkeypatch.setattr(correlation, "GIVEN", 50)
    cells = cut(maps.from_upper(random_map(spark, 30, 6, ("s", "t"), share)).where("sample = 's' or bin1 > 20 and bin2 > 20"))
    made = correlation._by_parts(cells, cells, high, own_cells)
    assert "join" not in plan(correlation.correlation_map(cells)) and "flatmapgroupsinarrow" in plan(made)
    got = {}
    for r in made.collect():
        got.setdefault(r.sample, {})[r.bin1, r.bin2] = r.value
    for s in "st":
        m = np.zeros((30, 30))
        for r in cells.where(F.col("sample") == s).collect():
            m[r.bin1, r.bin2] = r.value
        with np.errstate(invalid="ignore", divide="ignore"):
            want = np.nan_to_num(np.corrcoef(m))
        assert len(got[s]) == 900 and all(np.isclose(v, want[k], atol=1e-9) for k, v in got[s].items())


@pytest.mark.parametrize("n, piece", [(60, 4096), (60, 16), (61, 16), (66, 21), (9, 4096)])
def test_insulation_writes_no_correlation(spark, monkeypatch, n, piece):
    monkeypatch.setattr(signals, "PIECE", piece)
    monkeypatch.setattr(correlation, "ROWS", 8)
    cells = cut(maps.from_upper(random_map(spark, 80, 7, ("s", "t"), 0.3).where(f"bin1 < {n} and bin2 < {n}").withColumn("n", F.lit(n).cast("long"))))
    bins, windows = cut(maps.mask_white_lines(cells)), [3, 5]
    want = {(r.sample, r.bin): r.score for r in signals.ri_score(cut(correlation.correlation_map(cells, band=2 * max(windows))), bins, windows).collect()}
    seen = []
    monkeypatch.setattr(signals, "local_score", lambda scores: seen.append(scores) or scores)
    monkeypatch.setattr(correlation, "_banded", None)
    signals.insulation(cells, windows)
    got = {(r.sample, r.bin): r.score for r in seen[0].collect()}
    assert got.keys() == want.keys() and len(want) == 2 * n
    assert all(got[k] == want[k] if want[k] is None else np.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("f", [lambda cells: signals.insulation(cells, [3, 5]), lambda cells: signals.blob_score(cells, 3)])
def test_no_unmasked_bin_is_kept(spark, monkeypatch, f):
    cells, kept = cut(maps.from_upper(random_map(spark, 60, 7, ("s", "t"), 0.5))), []
    monkeypatch.setattr(signals, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    f(cells)
    masks = [df.collect() for df in kept if "masked" in df.columns]
    assert len(masks) == 1 and 2 <= len(masks[0]) < 20 and sum(not r.masked for r in masks[0]) <= 2


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_cells_meet_white_lines_where_they_are(spark, monkeypatch, few):
    monkeypatch.setattr(maps, "FEW_LINES", few, raising=False)
    cells = cut(maps.from_upper(random_map(spark, 40, 8, ("s",), 0.6).where("bin1 <> 20 and bin2 <> 20")))
    lines = [3, 9, 10, 20, 22]
    bins = cut(spark.range(40).select(F.lit("s").alias("sample"), F.lit("c").alias("chrom"), F.lit(40).cast("long").alias("n"), F.col("id").alias("bin"), F.col("id").isin(lines).alias("masked")))
    made = maps.interpolate_white_lines(cells, bins)
    # Masked bins are what cells meet, not all others.
    assert "leftanti" in plan(made) and "leftsemi" not in plan(made)
    m = np.zeros((40, 40))
    for r in cells.collect():
        m[r.bin1, r.bin2] = r.value
    m[lines], m[:, lines] = np.nan, np.nan
    want = {}
    for i in range(40):
        for j in range(40):
            v = m[i, j]
            if {i, j} & {3, 20, 22} and 2 <= min(i, j) and max(i, j) <= 37:
                around = [m[i + d, j + d] for d in (-2, -1, 1, 2)]
                v = np.nanmean(around) if not np.isnan(around).all() else 0.0
            if v and not np.isnan(v):
                want[i, j] = v
    got = {(r.bin1, r.bin2): r.value for r in made.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_pileups_make_no_maps_of_samples_without_genes(spark, monkeypatch):
    from contactloom.operators import pileup
    from contactloom.plans import workloads

    upper = random_map(spark, 40, 4, ("s", "t"), 0.5)
    genes = spark.createDataFrame([("s", "c", k, 900 * k, "+-"[k % 2], float(k)) for k in range(9)], "sample string, chrom string, gene_id long, tss long, strand string, rpkm double")
    chroms = spark.createDataFrame([("c", 40_000)], "chrom string, length long")
    seen, whole = [], maps.mask_white_lines
    monkeypatch.setattr(maps, "mask_white_lines", lambda cells, *a, **k: seen.append({r.sample for r in cells.select("sample").distinct().collect()}) or whole(cells, *a, **k))
    made = workloads.gene_contrast(upper, genes, chroms, 1000, 3000, 50, 300)
    assert seen == [{"s"}] and {r.sample for r in made.collect()} == {"s"}
    assert pileup.of_features(upper, genes).count() == upper.where("sample = 's'").count()


@pytest.mark.parametrize("rows, share", [(64, 0.01), (1 << 18, 0.01), (64, 0.6)])
def test_windows_of_sparse_maps_need_no_group_for_each_tile(spark, monkeypatch, rows, share):
    from contactloom.operators import boxes

    monkeypatch.setattr(boxes, "ROWS", rows)
    cells = cut(maps.from_upper(random_map(spark, 150, 8, ("s", "t"), share)))
    assert "mapinarrow" in plan(boxes.box_sums(cells, [2])) and "flatmapgroups" not in plan(boxes.box_sums(cells, [2]))
    got = {}
    for r in boxes.box_sums(cells, [2, 1], tile=16).collect():
        assert (r.sample, r.half, r.bin1, r.bin2) not in got
        got[r.sample, r.half, r.bin1, r.bin2] = (r.stored, r.total)
    want = {}
    for s in "st":
        m = np.zeros((150, 150))
        for r in cells.where(F.col("sample") == s).collect():
            m[r.bin1, r.bin2] = r.value
        for h in (1, 2):
            for i in range(150):
                for j in range(150):
                    v = m[max(0, i - h) : i + h + 1, max(0, j - h) : j + h + 1]
                    if v.any():
                        want[s, h, i, j] = (np.count_nonzero(v), v.sum())
    assert got == want


@pytest.mark.parametrize("half", [0, 2, 30])
def test_cells_of_windows_are_counted_without_their_rows(spark, half):
    at = spark.range(20).select(F.col("id").alias("i")).join(spark.range(20).select(F.col("id").alias("j"))).withColumn("n", F.lit(20).cast("long"))
    made = at.select("i", "j", *[maps.window_cells(F.col("i"), F.col("j"), F.col("n"), half, x).alias(f"c{int(x)}") for x in (False, True)])
    assert "sequence" not in plan(made)
    m = np.triu(np.ones((20, 20)))
    for r in made.where("i <= j").collect():
        at = np.s_[max(0, r.i - half) : r.i + half + 1, max(0, r.j - half) : r.j + half + 1]
        assert (r.c0, r.c1) == (m[at].size, m[at].sum())


def test_ends_of_cells_are_not_summed_beside_the_cells(spark):
    cells = cut(random_map(spark, 60, 2, ("s", "t")))
    made = maps.bin_sums(cells)
    before, _, after = plan(made).rpartition("exchange hashpartitioning(sample")
    assert "repartition_by_col" in after and "hashaggregate" not in after and "exchange" not in before
    want = {}
    for r in cells.collect():
        for b in {r.bin1, r.bin2}:
            want[r.sample, b] = want.get((r.sample, b), 0.0) + r.value
    assert {(r.sample, r.bin): r.total for r in made.collect()} == want


def test_deviations_of_bin_sums_read_the_map_once(spark, monkeypatch):
    cells = random_map(spark, 60, 2, ("s", "t"))
    seen, whole = [], maps.bin_sums
    monkeypatch.setattr(maps, "bin_sums", lambda c: seen.append(1) or whole(c))
    monkeypatch.setattr(maps, "all_bins", None)
    made = maps.bin_sums_mad(cells)
    assert "scan existingrdd" in plan(made) and len(seen) == 1
    got = {r.sample: (r["median"], r["mad"]) for r in made.collect()}
    for s in "st":
        m = np.zeros((60, 60))
        for r in cells.where(F.col("sample") == s).collect():
            m[r.bin1, r.bin2] = m[r.bin2, r.bin1] = r.value
        mid = np.median(m.sum(0))
        assert got[s] == (mid, np.median(abs(m.sum(0) - mid)))


def test_scalograms_do_not_order_positions_without_cells(spark):
    cells = cut(maps.from_upper(random_map(spark, 48, 3, ("s", "t"), 0.6)))
    made = signals.antidiagonal_scalogram(cells, 1000, [4000, 9000])
    # The percentile is an aggregate of stored positions, no window over all of them, and no join with a grid fills the others.
    assert "percentile(" in plan(made) and not any("percentile" in x for x in plan(made).splitlines() if " window" in x or "+- window" in x)
    sizes = {"4000": F.lit(2), "9000": F.lit(4), "half": F.floor(F.col("n") / 4)}
    means = {(r.sample, r["size"], r.pos): r.score for r in signals.partial_antidiagonals(cells, sizes).collect()}
    assert len(means) == 2 * 3 * 96
    level = {s: np.percentile([v for k, v in means.items() if k[:2] == (s, "half")], 5) for s in "st"}
    got = {(r.sample, r["size"], r.pos): r.score for r in made.collect()}
    assert got.keys() == means.keys()
    assert all(got[k] is None if level[k[0]] == 0 else np.isclose(got[k], means[k] / level[k[0]]) for k in means) and max(level.values()) > 0


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_kernels_add_cells_to_centres(spark, monkeypatch, block):
    monkeypatch.setattr(signals, "BLOCK", block)
    n, s = 31, 2
    cells = maps.from_upper(random_map(spark, n, 5, share=0.5))
    ext = cut(maps.circular_extend(cells, s))
    bins = spark.range(-s, n + s).select(F.lit("s").alias("sample"), F.lit("c").alias("chrom"), F.lit(n).cast("long").alias("n"), F.col("id").alias("bin"), F.col("id").isin(-1, 4, 8, 9, 10, 11, 12, 30).alias("masked"))
    made = signals.diagonal_convolution(ext, bins, s)
    assert "flatmapcogroupsinarrow" in plan(made) and "sortmergejoin" not in plan(made)
    m, seen = np.zeros((n + 2 * s, n + 2 * s)), ~np.isin(np.arange(-s, n + s), [-1, 4, 8, 9, 10, 11, 12, 30])
    for r in ext.collect():
        m[r.bin1 + s, r.bin2 + s] = r.value
    a = np.arange(2 * s + 1)
    kernel = np.exp(-0.5 * (0.5 * (abs(np.subtract.outer(a, a)) + abs(2 * s - np.add.outer(a, a))) / (2 * s)) ** 2) / np.sqrt(2.0)
    m[~seen] = m[:, ~seen] = 0
    got = {r.bin: r.score for r in made.collect()}
    assert sorted(got) == list(range(n)) and got[10] is None
    for k in range(n):
        at = slice(k, k + 2 * s + 1)
        if seen[at].any():
            assert np.isclose(got[k], (m[at, at] * kernel).sum() / seen[at].sum() ** 2)
