"""How much is exchanged and how many rows plans make, and results where operators go more than one round."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions.blocks import carried, dealt
from contactloom.operators import balance, boxes, correlation, edits, intervals, maps, pileup, products, selection, signals, similarity
from contactloom.plans.lineage import cut
from contactloom.sources import tables

MAP = "sample string, chrom string, n long, bin1 long, bin2 long, value double"


def dense_map(spark, n, seed, samples=("s",), share=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in samples:
        m = np.triu(rng.poisson(3 + 20 / (1 + abs(np.arange(n)[:, None] - np.arange(n))), (n, n)))
        rows += [(s, "c", n, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m)) if rng.random() < share]
    return spark.createDataFrame(rows, MAP)


def matrix(df, n, value="value"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.bin1, r.bin2] = r[value]
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- pileups


@pytest.mark.parametrize("circular", [True, False])
@pytest.mark.parametrize("n", [120, 480])
def test_windows_meet_little_more_than_they_keep(spark, n, circular):
    cells = maps.from_upper(dense_map(spark, n, 1, share=0.3)).cache()
    w = 12
    genes = spark.createDataFrame([("s", "c", g, g * n * 100 // 50, "+-"[g % 2]) for g in range(50)], "sample string, chrom string, gene_id long, tss long, strand string")
    chroms = spark.createDataFrame([("c", n * 100)], "chrom string, length long")
    bins = maps.all_bins(cells).withColumn("masked", F.lit(False))
    windows = pileup.feature_windows(genes, chroms, 100, w * 100, circular)
    met = pileup.meet_tiles(cells, windows, w, circular).count()
    held, _ = pileup.extract_windows(cells, bins, genes, chroms, 100, w * 100, circular)
    kept = held.count()
    assert kept and met <= 3 * kept
    # Each window as a plain slice of the map.
    m = matrix(cells, n)
    got = {}
    for r in held.collect():
        got.setdefault(r.gene_id, np.zeros((2 * w + 1, 2 * w + 1)))[r.di + w, r.dj + w] = r.value
    for r in windows.collect():
        at = (r.at + np.arange(2 * w + 1)) % n if circular else r.at + np.arange(2 * w + 1)
        inside = (at >= 0) & (at < n)
        want = np.where(np.outer(inside, inside), m[np.ix_(np.clip(at, 0, n - 1), np.clip(at, 0, n - 1))], 0)
        want = want[::-1, ::-1] if r.turned else want
        assert np.array_equal(got.get(r.gene_id, np.zeros_like(want)), want)


# ---- products and balancing


def test_a_product_has_no_exchange_and_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = dense_map(spark, 40, 2, ("a", "b", "c"))
    held = products.Held(cells, width=2, block_cells=100, group_bytes=2 * 40 * 2 * 8)
    assert [len(g) for g in held.groups] == [2, 1]
    seen = []
    made = type(cells).mapInArrow
    monkeypatch.setattr(type(cells), "mapInArrow", lambda self, *a, **k: seen.append(made(self, *a, **k)) or seen[-1])
    for group, ks in enumerate(held.groups):
        vectors = {k: rng.standard_normal((40, 2)) for k in ks}
        got = held.products(group, vectors)
        for k in ks:
            assert np.allclose(got[k], matrix(cells.where(F.col("sample") == held.maps[k][0]), 40) @ vectors[k])
    assert seen and not any("Exchange" in plan(x) for x in seen)
    held.close()


def plain_ice(m, iterations, n_mad, tol, ignore):
    n = len(m)
    m = np.where(abs(np.subtract.outer(np.arange(n), np.arange(n))) >= ignore, m, 0)
    total = m.sum(axis=1)
    log = np.log10(np.where(total == 0, 1, total))
    good = log > np.median(log) - n_mad * 1.4826 * np.median(abs(log - np.median(log)))
    m = m[np.ix_(good, good)]
    bias = np.ones(len(m))
    for _ in range(iterations):
        sums = bias * (m @ bias)
        bias = bias / (sums / np.median(sums))
        if np.var(sums) * 4 < tol:
            break
    out = np.full(n, np.nan)
    out[good] = bias / np.sqrt(np.median(bias * (m @ bias)))
    return out


def test_balancing_to_the_end_equals_numpy(spark):
    cells = dense_map(spark, 60, 3, ("a", "b")).where("bin1 <> 7 and bin2 <> 7")
    got = balance.balance_ice(cells).collect()
    for s in "ab":
        upper = matrix(cells.where(F.col("sample") == s), 60)
        want = plain_ice(upper + np.triu(upper, 1).T, 200, 3.0, 1e-5, 2)
        mine = np.array([r.bias if r.bias is not None else np.nan for r in sorted((r for r in got if r.sample == s), key=lambda r: r.bin)])
        assert np.array_equal(np.isnan(mine), np.isnan(want)) and np.allclose(mine, want, equal_nan=True)
    sums = maps.bin_sums(maps.zero_diags(maps.apply_bias(cells, balance.balance_ice(cells)))).collect()
    assert abs(np.median([r.total for r in sums]) - 1) < 0.05
    assert balance.balance_ice(cells.limit(0)).count() == 0


def test_maps_without_a_cell_have_all_their_bins_if_they_are_named(spark):
    cells = dense_map(spark, 12, 5)
    every = spark.createDataFrame([("s", "c", 12), ("t", "c", 3)], "sample string, chrom string, n long")
    empty = lambda df: sorted(r.bin for r in df.where("sample = 't'").collect())
    assert empty(maps.good_bins(cells, every=every).where("not good")) == empty(maps.mask_white_lines(maps.from_upper(cells), every=every).where("masked")) == [0, 1, 2]
    got = balance.balance_ice(cells, every=every)
    assert empty(got.where("bias is null")) == [0, 1, 2] and got.count() == 15 and got.where("bias is not null").count() > 6
    assert maps.good_bins(cells, every=every).where("sample = 's'").count() == 12 and empty(maps.good_bins(cells)) == []
    assert empty(maps.good_bins(cells.limit(0), every=every)) == [0, 1, 2]


def test_normalising_to_the_end_equals_numpy(spark):
    cells = maps.from_upper(dense_map(spark, 30, 4))
    m = matrix(cells, 30)
    want = m.copy()
    for _ in range(60):
        want = want / np.linalg.norm(want, axis=0)
        want = want / np.linalg.norm(want, axis=1)[:, None]
    assert np.allclose(matrix(balance.normalize_scn(cells, 60, 0.0), 30), (want + want.T) / 2, rtol=1e-6)


# ---- window sums


def test_window_sums_have_two_rows_a_range(spark):
    cells = maps.from_upper(dense_map(spark, 50, 6)).cache()
    r, c = F.col("bin1"), F.col("bin2")
    near = cells.where((c >= r) & (c - r < 20))
    ranges = {"a": (r - 15, c + 15), "b": (r, c)}
    got = signals.range_sums(near, ranges, maps.all_bins(cells)).collect()
    assert "Generate inline" in plan(signals.range_sums(near, ranges, maps.all_bins(cells)))
    rows = near.collect()
    for x in got:
        assert np.isclose(x.a, sum(v.value for v in rows if v.bin1 - 15 <= x.bin <= v.bin2 + 15)) and np.isclose(x.b, sum(v.value for v in rows if v.bin1 <= x.bin <= v.bin2))


@pytest.mark.parametrize("half", [0, 1, 3, 40])
def test_box_sums_equal_slices(spark, half):
    cells = maps.from_upper(dense_map(spark, 45, 7, share=0.05))
    m = matrix(cells, 45)
    got = boxes.box_sums(cells, [half, 1], tile=16).where(F.col("half") == half).dropDuplicates(["bin1", "bin2"]).collect()
    want = {(i, j): m[max(0, i - half) : i + half + 1, max(0, j - half) : j + half + 1] for i in range(45) for j in range(45)}
    assert {(r.bin1, r.bin2): (r.stored, r.total) for r in got} == {k: (np.count_nonzero(v), v.sum()) for k, v in want.items() if v.any()}
    near = boxes.box_sums(cells, [half], tile=16, upper=True, band=5).collect()
    assert {(r.bin1, r.bin2): r.stored for r in near} == {k: np.count_nonzero(v) for k, v in want.items() if v.any() and 0 <= k[1] - k[0] <= 5}


# ---- similarity


def plain_scc(a, b, h, band):
    n = len(a)

    def smoothed(m):
        mean = lambda i, j: m[max(0, i - h) : i + h + 1, max(0, j - h) : j + h + 1].mean()
        return np.array([[mean(i, j) if 0 <= j - i <= band else 0 for j in range(n)] for i in range(n)])

    x, y, top, low = smoothed(a), smoothed(b), 0.0, 0.0
    for d in range(band + 1):
        u, v = np.diagonal(x, d), np.diagonal(y, d)
        either = (u != 0) | (v != 0)
        if either.any():
            u, v = u[either], v[either]
            top += len(u) * np.mean((u - u.mean()) * (v - v.mean()))
            low += len(u) * np.sqrt(u.var() * v.var())
    return top / low


def test_training_of_h_equals_numpy_on_the_same_draws(spark):
    """Sparse maps of one pattern need some smoothing before it pays no more."""
    rng = np.random.default_rng(8)
    n, band, repeats, gain = 40, 8, 3, 0.03
    wave = 2 + np.sin(np.arange(n) / 3)
    rows = []
    for s in "abc":
        m = np.triu(rng.poisson(np.outer(wave, wave) * 9 / (1 + abs(np.subtract.outer(np.arange(n), np.arange(n))))))
        rows += [(s, "c", n, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    upper = spark.createDataFrame(rows, MAP)
    totals = upper.groupBy("sample").agg(F.floor(F.sum("value") * 0.1).cast("long").alias("size"))
    draws = [maps.from_upper(maps.subsample(upper, totals, seed)).collect() for seed in range(repeats)]
    whole = {}
    for k, draw in enumerate(draws):
        for s in "abc":
            whole[k, s] = np.zeros((n, n))
        for r in draw:
            whole[k, r.sample][r.bin1, r.bin2] = r.value
    want = 0
    for a, b in ("ab", "ac", "bc"):
        curve = [np.mean([plain_scc(whole[k, a], whole[k, b], h, band) for k in range(repeats)]) for h in range(11)]
        want = max(want, next((h for h in range(10) if curve[h + 1] - curve[h] < gain), 10))
    assert want > 1 and similarity.train_h(upper, band, 10, repeats, gain) == want


# ---- subsamples


@pytest.mark.parametrize("size, seed", [(1, 0), (300, 1), (1000, 2), (0, 3), (10**9, 4)])
def test_subsample_takes_the_lowest_hashes(spark, size, seed):
    cells = dense_map(spark, 20, 9, ("a", "b", "c"))
    units = cells.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("value").cast("long")))).withColumn("hash", F.xxhash64("sample", "chrom", "bin1", "bin2", "unit", F.lit(seed)))
    want = {}
    for s in "abc":
        mine = sorted((r.hash, r.bin1, r.bin2) for r in units.where(F.col("sample") == s).collect())
        for _, i, j in mine[: size or len(mine)]:
            want[s, i, j] = want.get((s, i, j), 0) + 1
    assert {(r.sample, r.bin1, r.bin2): r.value for r in maps.subsample(cells, size, seed).collect()} == want


def test_subsample_of_very_many_contacts(spark):
    cells = spark.createDataFrame([("a", "c", 4, i, j, 3e5) for i in range(4) for j in range(i, 4)], MAP)
    drawn = maps.subsample(cells, 1_000_000)
    assert drawn.agg(F.sum("value")).first()[0] == 1_000_000 and drawn.count() == 10


# ---- percentiles, positions, sequences


@pytest.mark.parametrize("p", [0, 0.01, 0.3, 0.5, 0.99, 1])
@pytest.mark.parametrize("few, ranges", [(1 << 16, 4096), (1, 3), (10, 16)])
def test_percentiles_equal_numpy(spark, p, few, ranges):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(0, 4, 300), -rng.lognormal(0, 4, 100), np.zeros(50), np.full(30, 7.25), [1e300, -1e300, 5e-324]])
    w = rng.integers(1, 5, len(v))
    rows = [("s", "c", float(a), int(b)) for a, b in zip(v, w)] + [("t", "c", 3.0, 2), ("t", "c", None, 2), (None, "c", 3.0, 1), (None, "c", 4.0, 1), ("u", "c", None, 1)]
    df = spark.createDataFrame(rows, "sample string, chrom string, x double, w long")
    got = {r.sample: r.percentile for r in selection.percentile_of(df, "x", p, weight="w", few=few, ranges=ranges).collect()}
    assert set(got) == {"s", "t", None} and np.isclose(got["s"], np.percentile(np.repeat(v, w), p * 100), rtol=1e-12) and got["t"] == 3 and np.isclose(got[None], 3 + p)


def test_location_has_a_row_for_each_piece_and_position(spark):
    layout = spark.createDataFrame([("s", "c", 0, "x", 0, 10**9, False), ("s", "c", 1, "y", 0, 10, True), ("s", "c", 2, "z", 5, 5, False)], "sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean")
    positions = spark.createDataFrame([("s", "c", x, "n") for x in (0, 5, 10**9 - 1, 10**9, 10**9 + 9, 10**9 + 10, -1, None)] + [("t", "c", 0, "n"), (None, "c", 0, "n")], "sample string, chrom string, coord long, note string")
    got = {(r.sample, r.coord): (r.ord, r.src_chrom, r.src_coord, r.outside) for r in intervals.locate(positions, layout).collect()}
    assert got == {
        ("s", 0): (0, "x", 0, False), ("s", 5): (0, "x", 5, False), ("s", 10**9 - 1): (0, "x", 10**9 - 1, False), ("s", 10**9): (1, "y", 9, False), ("s", 10**9 + 9): (1, "y", 0, False),
        ("s", 10**9 + 10): (None, None, None, True), ("s", -1): (None, None, None, True), ("s", None): (None, None, None, True), ("t", 0): (None, None, None, True), (None, 0): (None, None, None, True),
    }


def test_blocks_carry_over_a_hot_group(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
        out = carried(dealt(rows, ["k"], "id"), ["k"], n=(F.count(F.lit(1)), F.sum("n")), last=(F.max("id"), F.max("last"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = {r.block: (r.n, r["last"]) for r in out if r.k == 1}
    assert len(hot) > 1
    for block, (n, last) in hot.items():
        earlier = [r.id for r in out if r.k == 1 and r.block < block]
        assert (n or 0, last) == (len(earlier), max(earlier, default=None))


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_sequences_in_chunks(spark, tmp_path, size):
    rng = np.random.default_rng(1)
    records = {f"r{k}": "".join(rng.choice(list("ACGTacgtN"), n)) for k, n in enumerate((0, 1, 59, 60, 61, 400))}
    text = "".join(f">{name} more words\n" + "\n".join(seq[k : k + 13] for k in range(0, len(seq), 13)) + "\n\n" for name, seq in records.items())
    (tmp_path / "x.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        chunks = tables.read_fasta_chunks(spark, str(tmp_path / "x.fa"), size).cache()
        got = {(r.chrom, r.chunk): r.seq for r in chunks.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(name, k): seq[k * size : (k + 1) * size] for name, seq in records.items() for k in range(-(-len(seq) // size))}
    pieces = [("s", "a", 0, "r5", 10, 300, True), ("s", "a", 1, "r4", 0, 61, False), ("s", "a", 2, "r5", 0, 400, False), ("s", "b", 0, "r3", 5, 5, True), ("s", "b", 1, "r1", 0, 1, True)]
    layout = spark.createDataFrame(pieces, T.StructType.fromDDL("sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean"))
    fasta = spark.createDataFrame(list(records.items()), "chrom string, seq string")
    whole = {(r.sample, r.chrom): r.seq for r in edits.sequences(layout, fasta).collect()}
    parts = {}
    for r in sorted(edits.sequence_chunks(layout, chunks, size).collect(), key=lambda r: r.chunk):
        parts[r.sample, r.chrom] = parts.get((r.sample, r.chrom), "") + r.seq
        assert len(r.seq) <= size
    assert parts == whole


def random_map(spark, n, count, seed, samples=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = {}
    for s in samples:
        for i, j, v in zip(*rng.integers(0, n, (2, count)), rng.integers(1, 9, count)):
            rows[s, min(i, j), max(i, j)] = float(v)
    upper = spark.createDataFrame([(s, "c", n, int(i), int(j), v) for (s, i, j), v in rows.items()], "sample string, chrom string, n long, bin1 long, bin2 long, value double")
    return maps.from_upper(upper)


@pytest.mark.parametrize("n, band", [(9, 5), (40, 3), (67, 4), (66, 8), (97, 8), (130, 2)])
def test_banded_correlations_join_nothing(spark, monkeypatch, n, band):
    """All pairs within the band, once, with the values of the whole correlations; maps are not joined with themselves."""
    monkeypatch.setattr(correlation, "SPAN", 32, raising=False)
    monkeypatch.setattr(correlation, "ROWS", 5, raising=False)
    monkeypatch.setattr(correlation, "COLUMNS", 7, raising=False)
    cells = random_map(spark, n, 3 * n, n)
    near = correlation.correlation_map(cells, band=band)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sample, r.bin1, r.bin2): r.value for r in near.collect()}
    want = {(r.sample, r.bin1, r.bin2): r.value for r in correlation.correlation_map(cells).collect() if min(abs(r.bin1 - r.bin2), n - abs(r.bin1 - r.bin2)) <= band}
    assert near.count() == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_compartments_of_small_maps_stay_in_tasks(spark, monkeypatch):
    cells = cut(random_map(spark, 40, 400, 3))
    want = {(r.sample, r.bin, r["rank"]): r.score for r in correlation.compartments(cells, own_cells=0).collect()}

    def held(*_, **__):
        raise AssertionError("vectors go to the driver")

    monkeypatch.setattr(correlation, "Held", held)
    got = {(r.sample, r.bin, r["rank"]): r.score for r in correlation.compartments(cells).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got)


@pytest.mark.parametrize("n", [17, 50, 61])
def test_insulation_sorts_no_map(spark, monkeypatch, n):
    """Scores are told by pieces of the diagonal, whose seams change nothing; no window goes over all bins of a map."""
    cells = cut(random_map(spark, n, 4 * n, n))
    bins = cut(maps.all_bins(cells).withColumn("masked", F.col("bin").isin(3, 4, 11)))
    score = lambda: signals.relative_insulation(cells, bins, [3, 5])
    assert "Window" not in plan(score())
    want = {(r.sample, r.bin, r.w): r.score for r in score().collect()}
    monkeypatch.setattr(signals, "PIECE", 10)
    got = {(r.sample, r.bin, r.w): r.score for r in score().collect()}
    assert got.keys() == want.keys() and len(got) == 4 * n
    assert all(got[k] is want[k] is None or abs(got[k] - want[k]) < 1e-12 for k in got)
    each = {(r.sample, r.bin): r.score for r in signals.ri_score(cells, bins, [3, 5]).collect()}
    for s, b in each:
        both = [got[s, b, 3], got[s, b, 5]]
        assert each[s, b] is None if None in both else abs(each[s, b] - sum(both) / 2) < 1e-12


def test_candidates_of_tracks_with_gaps(spark, tmp_path):
    """The query on a track that begins behind bin 0 has the highest score there; what is missing beside it is no obstacle."""
    from contactloom.plans import queries

    high = {5: 9.0, 6: 1.0, 7: 2.0, 8: 1.0, 30: 8.0, 31: 8.0, 40: 7.0, 63: 9.5}
    events = [(bin * 1000, "x", high.get(bin, 1.0)) for bin in range(5, 64) if bin not in (39, 41)]
    # Event k lies at k * 37 mod 64000, so that the event at p is p times the inverse of 37.
    rows = [(p * pow(37, -1, 64_000) % 64_000, kind, v) for p, kind, v in events]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.QUERIES["a07_candidate_borders"](spark, str(tmp_path)).collect()
    assert sorted(r.bin for r in got) == [5, 40]
