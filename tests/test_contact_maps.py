"""Small cases with known results, invariants, and independent numpy versions."""

import inspect
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.functions.columns import region_part, unit_scale
from contactloom.operators import balance, correlation, edits, intervals, maps, oriter, pileup, signals, similarity, tracks
from contactloom.plans import fixtures, queries
from contactloom.sources import tables

MAP = "sample string, chrom string, n long, bin1 long, bin2 long, value double"

# A 6 x 6 and a 7 x 7 matrix and the profiles that are known for them.
M1 = [
    [1.0, 0.97, 0.94, 0.06, 0.58, 0.61], [0.25, 1.0, 0.29, 0.32, 0.81, 0.7], [0.11, 0.07, 1.0, 0.73, 0.93, 0.87],
    [0.7, 0.96, 0.76, 1.0, 0.46, 0.27], [0.71, 0.89, 0.51, 0.48, 1.0, 0.98], [0.86, 0.14, 0.46, 0.66, 0.24, 1.0],
]
M1_PROFILE = [1.82905, 1.49145, 1.70085, 1.00000, 1.95299, 1.99145] * 2
M2 = [
    [1.0, 0.47, 0.07, 0.07, 0.4, 0.74, 0.27], [0.47, 1.0, 0.97, 0.63, 0.93, 0.89, 0.07], [0.16, 0.85, 1.0, 0.72, 0.3, 0.44, 0.81], [0.48, 0.62, 0.9, 1.0, 0.83, 0.68, 0.67],
    [0.89, 0.17, 0.67, 0.1, 1.0, 0.28, 0.57], [0.88, 0.95, 0.67, 0.26, 0.96, 1.0, 0.81], [0.32, 0.99, 0.23, 0.68, 0.11, 0.24, 1.0],
]
M2_PROFILE = [3.24818, 1.48218, 1.68716, 2.86975, 2.57016, 2.55439, 2.04982, 1.46641, 2.64900, 1.95521, 2.47556, 1.65562, 4.13118, 0.93030]


def frame(spark, matrix, sample="s"):
    rows = [(sample, "c", len(matrix), i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, MAP)


def dense(cells, n, offset=0):
    out = np.zeros((n, n))
    for r in cells.collect():
        out[r.bin1 + offset, r.bin2 + offset] = r.value
    return out


def vector(scores, column="score", index="bin"):
    return np.array([r[column] if r[column] is not None else np.nan for r in scores.orderBy(index).collect()])


def random_map(n, seed, empty=()):
    rng = np.random.default_rng(seed)
    m = rng.poisson(3, (n, n)).astype(float)
    m = m + m.T
    for k in empty:
        m[k], m[:, k] = 0, 0
    return m


def test_antidiagonal_golden(spark):
    got = vector(signals.antidiagonal(frame(spark, M1), ignore_diags=0), index="pos")
    assert np.allclose(got, M1_PROFILE, rtol=1e-5)


def test_partial_antidiagonal_golden(spark):
    cells = frame(spark, M2)
    means = vector(signals.partial_antidiagonals(cells, {"s": F.lit(1)}, ignore_diags=0), index="pos")
    counts = np.array([2 if p in (6, 13) or 7 - abs(p - 6) >= 2 else 7 - abs(p - 6) + 2 * (1 - (7 - abs(p - 6)) // 2) for p in range(14)])
    known = means * counts / 2
    assert np.allclose(known / np.percentile(known, 1), M2_PROFILE, rtol=1e-5)


def test_symmetrize(spark):
    for before, after, symmetric in (([[0, 0, 1], [0, 1, 0], [0, 0, 1]], [[0, 0, 1], [0, 1, 0], [1, 0, 1]], False), ([[0, 0, 1], [0, 1, 0], [1, 0, 0]],) * 2 + (True,)):
        cells = frame(spark, before)
        assert (dense(maps.symmetrize(cells), 3) == after).all() and maps.is_symmetric(cells).first().symmetric == symmetric
        assert (dense(maps.symmetrize(maps.symmetrize(cells)), 3) == after).all()


def test_extend_and_zero_diags(spark):
    assert (dense(maps.circular_extend(frame(spark, [[1, 2], [3, 4]]), 1), 4, 1) == [[4, 3, 4, 3], [2, 1, 2, 1], [4, 3, 4, 3], [2, 1, 2, 1]]).all()
    assert (dense(maps.zero_diags(frame(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])), 3) == [[0, 0, 3], [0, 0, 0], [7, 0, 0]]).all()


def test_di_borders(spark):
    for values, want in (([0.5, 2, 3, 4, 0.1, -3.2, -3.5, 0], [5]), ([0.5, 2, 3, 4, 0.1, -3.2, 4, -2], [5, 7])):
        scores = spark.createDataFrame([("s", "c", 8, i, float(v)) for i, v in enumerate(values)], "sample string, chrom string, n long, bin long, score double")
        assert sorted(r.bin for r in signals.di_borders(scores).collect()) == want


def test_center_of_intervals(spark):
    chroms = spark.createDataFrame([("c", 1000)], "chrom string, length long")
    for rows, circular, want in (([(10, 30), (980, 1000)], True, 5), ([(10, 30), (980, 1000)], False, 505), ([(10, 30), (40, 60)], True, 35)):
        sites = spark.createDataFrame([("c", *r) for r in rows], "chrom string, start long, end long")
        assert oriter.interval_center(sites, chroms, circular).first().center == want


def test_units_and_regions(spark):
    row = spark.createDataFrame([("KB", "mb", "chr1:1,000-2000", "x")], "a string, b string, r string, z string")
    got = row.select(unit_scale(F.col("a")), unit_scale(F.col("b")), region_part(F.col("r"), "chrom"), region_part(F.col("r"), "start"), region_part(F.col("r"), "end"), unit_scale(F.col("z")), region_part(F.col("z"), "start")).first()
    assert tuple(got) == (0.001, 1e-6, "chr1", 1000, 2000, None, None)


def test_peaks_with_plateaus(spark):
    scores = spark.createDataFrame([("s", "c", 10, i, float(v)) for i, v in enumerate([5, 1, 3, 3, 3, 2, 4, 4, 1, 9])], "sample string, chrom string, n long, bin long, score double")
    assert sorted(r.bin for r in signals.find_peaks(scores).collect()) == [3, 6]
    assert sorted(r.bin for r in signals.find_peaks(scores, negate=True).collect()) == [1, 5, 8]


@pytest.mark.parametrize("shift", [0, 5])
def test_rotation_rotates_signals(spark, shift):
    m = random_map(24, 1, (7,))
    turned = np.roll(m, (shift, shift), (0, 1))
    for f in (lambda c: signals.hic_signal(c, 1, 4), lambda c: signals.ri_score(c, maps.mask_white_lines(c), [3, 4])):
        assert np.allclose(np.roll(vector(f(frame(spark, m))), shift), vector(f(frame(spark, turned))), equal_nan=True)


def test_correlation_and_eigenvectors_equal_numpy(spark):
    m = random_map(20, 2)
    cells = frame(spark, m)
    assert np.allclose(dense(correlation.correlation_map(cells), 20), np.corrcoef(m))
    law = np.array([np.diagonal(m, k).mean() for k in range(20)])
    i, j = np.indices(m.shape)
    c = np.corrcoef(m / law[abs(i - j)])
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-abs(values))
    got = correlation.compartments(cells, steps=60, count=1)
    want = vectors[:, order[0]]
    want = want * np.sign(want[abs(want).argmax()])
    assert np.allclose(vector(got), want, atol=1e-3)


def eigenvectors(m, count):
    """The leading eigenvectors of the correlations of the detrended map, null rows left out."""
    kept = np.flatnonzero(m.any(0))
    law = np.array([np.diagonal(m, k).mean() for k in range(len(m))])
    i, j = np.indices(m.shape)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(np.nan_to_num(m / law[abs(i - j)])))
    values, vectors = np.linalg.eigh(c)
    best = vectors[:, np.argsort(-abs(values))[:count]].T
    return [v[kept] * np.sign(v[abs(v).argmax()]) for v in best]


def test_both_eigenvectors_equal_numpy(spark):
    both = {name: random_map(24, seed) for name, seed in (("a", 2), ("b", 9))}
    got = correlation.compartments(frame(spark, both["a"], "a").unionByName(frame(spark, both["b"], "b"))).cache()
    for name, m in both.items():
        for rank, want in enumerate(eigenvectors(m, 2), 1):
            assert np.allclose(vector(got.where((F.col("sample") == name) & (F.col("rank") == rank))), want, atol=1e-5)


def test_compartments_query_equals_numpy_for_all_samples(spark, sf_dir):
    cells = {}
    for r in fixtures.whole(spark, sf_dir).collect():
        cells.setdefault((r.sample, r.chrom), np.zeros((r.n, r.n)))[r.bin1, r.bin2] = r.value
    got = {}
    for r in sorted(queries.QUERIES["a19_compartments"](spark, sf_dir).collect(), key=lambda r: r.bin):
        got.setdefault((r.sample, r.chrom, r.rank), []).append(r.score)
    assert {k[0] for k in cells} == {"A", "N", "R"} and len(got) == 2 * len(cells)
    for key, m in cells.items():
        for rank, want in enumerate(eigenvectors(m, 2), 1):
            assert np.allclose(got[*key, rank], want, atol=1e-4)


def test_balancing_evens_sums(spark):
    m = np.triu(random_map(30, 3, (4,)))
    upper = frame(spark, m)
    biases = balance.balance_ice(upper, n_mad=10)
    whole = dense(maps.from_upper(maps.apply_bias(maps.zero_diags(upper), biases)), 30)
    sums = np.delete(whole.sum(0), 4)
    assert np.allclose(sums, 1, atol=0.02) and biases.where("bias is null").collect()[0].bin == 4
    scn = dense(balance.normalize_scn(frame(spark, m + m.T)), 30)
    assert np.allclose(scn, scn.T)


def test_iterative_queries_run_to_their_end(spark, sf_dir, monkeypatch):
    given = []
    for module, name in ((balance, "normalize_scn"), (balance, "balance_ice"), (similarity, "train_h"), (similarity, "hicrep_matrix")):
        whole = inspect.signature(getattr(module, name))

        def seen(*a, whole=whole, name=name, **k):
            bound = whole.bind(*a, **k)
            bound.apply_defaults()
            given.append((name, {x: bound.arguments[x] for x in ("iterations", "h_max", "repeats", "h") if x in bound.arguments}))
            return a[0] if name != "train_h" else 7

        monkeypatch.setattr(module, name, seen)
    monkeypatch.setattr(balance, "balanced", lambda cells, **k: balance.balance_ice(cells, **k))
    monkeypatch.setattr(signals, "insulation", lambda cells, windows: (cells, cells))
    for name in ("m17_normalize_scn_full", "a22_train_h", "w1_borders", "w4_similarities"):
        queries.QUERIES[name](spark, sf_dir)
    trained = ("train_h", {"h_max": 10, "repeats": 10})
    assert given == [("normalize_scn", {"iterations": 10}), trained, ("balance_ice", {"iterations": 200}), trained, ("hicrep_matrix", {"h": 7})]


def test_subsample_keeps_so_many(spark):
    upper = frame(spark, np.triu(random_map(20, 4)))
    total = int(upper.agg(F.sum("value")).first()[0])
    for k in (0, 1, 57, total, total + 5):
        got = maps.subsample(upper, k, seed=3)
        assert int(got.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]) == (total if k == 0 else min(k, total))
        assert got.join(upper.withColumnRenamed("value", "old"), list(maps.CELL)).where("value > old").count() == 0


def test_map_is_like_itself(spark):
    a = frame(spark, random_map(16, 5), "a")
    both = a.unionByName(a.withColumn("sample", F.lit("b")))
    assert abs(similarity.scc(both, similarity.sample_pairs(both), 5, 1).first().scc - 1) < 1e-9


def test_smoothing_equals_numpy(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=90)
    track = spark.createDataFrame([("s", "c", i, float(x)) for i, x in enumerate(v)], "sample string, chrom string, pos long, value double")
    chroms = spark.createDataFrame([("c", 90)], "chrom string, length long")
    w = tracks._gaussian(2.0)
    for circular, mode in ((True, "wrap"), (False, "edge")):
        want = np.convolve(np.pad(v, len(w) // 2, mode=mode), w, "valid")
        assert np.allclose(vector(tracks.smooth(track, chroms, 2.0, circular, chunk=17), "value", "pos"), want)


def test_pileup_of_a_linear_chromosome(spark):
    m = random_map(20, 7)
    cells = frame(spark, m)
    genes = spark.createDataFrame([("s", "c", "1", 1500, "+"), ("s", "c", "2", 9500, "-")], "sample string, chrom string, gene_id string, tss long, strand string")
    chroms = spark.createDataFrame([("c", 20_000)], "chrom string, length long")
    bins = maps.all_bins(cells).withColumn("masked", F.lit(False))
    stack = {(r.di, r.dj): r.value for r in pileup.pileup(*pileup.extract_windows(cells, bins, genes, chroms, 1000, 3000, circular=False), genes, 3).collect()}
    place = lambda tss: int(np.round((tss - 3000) / 1000 - 0.5)) + 3
    for (di, dj), got in stack.items():
        values = [m[p + s * di, p + s * dj] for p, s in ((place(1500), 1), (place(9500), -1)) if 0 <= p + s * di < 20 and 0 <= p + s * dj < 20]
        assert np.isclose(got, np.mean(values))


def test_edits(spark):
    layout = spark.createDataFrame([("s", "a", 0, "a", 0, 100, False), ("s", "b", 0, "b", 0, 50, False)], edits._LAYOUT)
    schema = "sample string, seq int, op string, chrom string, pos long, start long, end long, src_chrom string, src_start long, src_end long, invert boolean"
    row = lambda seq, op, **k: ("s", seq, op, k.get("chrom", "a"), k.get("pos"), k.get("start"), k.get("end"), k.get("src_chrom"), k.get("s0"), k.get("s1"), k.get("invert", False))
    run = lambda *rows: {c: [(r.src_chrom, r.start, r.end, r.is_reverse) for r in edits.apply_edits(layout, spark.createDataFrame(list(rows), schema)).orderBy("ord").collect() if r.chrom == c] for c in "ab"}
    assert run(row(0, "invert", start=10, end=30))["a"] == [("a", 0, 10, False), ("a", 10, 30, True), ("a", 30, 100, False)]
    twice = run(row(0, "invert", start=10, end=30), row(1, "invert", start=10, end=30))["a"]
    assert twice == [("a", 0, 10, False), ("a", 10, 30, False), ("a", 30, 100, False)]
    assert run(row(0, "delete", start=0, end=100))["a"] == []
    assert run(row(0, "duplicate", start=0, end=10, pos=100))["a"] == [("a", 0, 10, False), ("a", 10, 100, False), ("a", 0, 10, False)]
    moved = run(row(0, "translocate", src_chrom="b", start=10, end=20, pos=50, invert=True))
    assert moved["a"] == [("a", 0, 50, False), ("b", 10, 20, True), ("a", 50, 100, False)] and moved["b"] == [("b", 0, 10, False), ("b", 20, 50, False)]
    assert run(row(0, "insert", pos=0, src_chrom="x", s0=5, s1=9))["a"][0] == ("x", 5, 9, False)
    with pytest.raises(Exception, match="outside"):
        run(row(0, "invert", start=10, end=300))


def test_sequences(spark):
    layout = spark.createDataFrame([("s", "a", 0, "a", 2, 5, True), ("s", "a", 1, "a", 0, 2, False)], edits._LAYOUT)
    fasta = spark.createDataFrame([("a", "AACGT")], "chrom string, seq string")
    assert edits.sequences(layout, fasta).first().seq == "ACGAA"


def test_split_outside_is_an_error(spark):
    rows = spark.createDataFrame([(1, "c", 0, 10, False)], "id long, chrom string, start long, end long, is_reverse boolean")
    with pytest.raises(Exception, match="outside"):
        intervals.split_intervals(rows, spark.createDataFrame([(1, 11)], "id long, at long")).collect()


def test_empty_maps(spark):
    empty = spark.createDataFrame([], MAP)
    for f in (maps.symmetrize, maps.mask_white_lines, maps.good_bins, maps.detrend, signals.hic_signal, signals.antidiagonal, correlation.correlation_map, lambda c: maps.window_density(c, 3)):
        assert f(empty).count() == 0


def test_masking_needs_no_order(spark):
    m = random_map(18, 8, (3, 9))
    cells = frame(spark, m)
    bins = maps.all_bins(cells).withColumn("masked", F.col("bin").isin(3, 9))
    a = maps.detrend(maps.unmasked(cells, bins))
    assert a.count() == maps.unmasked(maps.detrend(cells), bins).count()


def test_readers_keep_types(spark, tmp_path):
    (tmp_path / "t.bed").write_text("c\t0\t3\t1.5\nc\t3\t3\t2\n")
    rows = tables.read_track(spark, str(tmp_path / "t.bed"), "s", per_position=True).collect()
    assert [(r.pos, r.value) for r in rows] == [(0, 1.5), (1, 1.5), (2, 1.5)]
    (tmp_path / "x.fa").write_text(">one first\nACG\nT\n>two\n\nGG\n")
    assert sorted(tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == [("one", "ACGT", 4), ("two", "GG", 2)]


def test_pixels_keep_their_last_cell_under_any_header(spark, tmp_path):
    for k, head in enumerate(("id_a\tid_b\tn_contact", "3\t3\t3", "2\t2\t3")):
        path = tmp_path / f"p{k}"
        path.mkdir()
        (path / "map.txt").write_text(f"{head}\n0\t1\t5\n1\t1\t2\n2\t2\t7\n")
        got = sorted((r.id1, r.id2, r.count_) for r in tables.read_pixels(spark, str(path), "s").withColumnRenamed("count", "count_").collect())
        assert got == [(0, 1, 5), (1, 1, 2), (2, 2, 7)]
        assert tables.read_pixels(spark, str(path), "s", header=False).count() == 4


def test_locate_keeps_repeated_positions(spark):
    layout = spark.createDataFrame([("s", "c", 0, "c", 0, 10, False), ("s", "c", 1, "c", 20, 30, True)], "sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean")
    positions = spark.createDataFrame([("s", "c", 3, "a")] * 3 + [("s", "c", 12, "b"), ("s", "c", 20, "x"), ("s", "c", 99, "x")], "sample string, chrom string, coord long, note string")
    got = Counter((r.coord, r.note, r.ord, r.src_coord, r.outside) for r in intervals.locate(positions, layout).collect())
    assert got == {(3, "a", 0, 3, False): 3, (12, "b", 1, 27, False): 1, (20, "x", None, None, True): 1, (99, "x", None, None, True): 1}


def test_overlaps_of_short_and_long_intervals(spark):
    import random

    rng = random.Random(4)

    def some(n):
        rows = []
        for i in range(n):
            start = rng.randrange(3_000_000)
            rows.append((i, rng.choice("xy"), start, start + rng.choice([0, 1, 30, 5000, 40_000, 2_000_000])))
        return rows

    a, b = some(120), some(120)
    schema = "id long, chrom string, start long, end long"
    want = sorted((i, j, min(e, f) - max(s, t)) for i, c, s, e in a for j, d, t, f in b if c == d and min(e, f) > max(s, t))
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert sorted((r.a_id, r.b_id, r.overlap) for r in got.collect()) == want
    empty = spark.createDataFrame([], schema)
    assert intervals.overlap_join(spark.createDataFrame(a, schema), empty).count() == intervals.overlap_join(empty, empty).count() == 0


def test_origins_by_coverage_equal_plain_numpy(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, (chrom, n) in enumerate((("a", 60), ("b", 90), ("c", 30), ("d", 75))):
        x = np.arange(n)
        v = np.zeros(n) if chrom == "d" else 5 + 2 * np.cos((x - 7 * k - 20) * 2 * np.pi / n) + rng.normal(0, 0.2, n)
        rows += [("s", chrom, int(i) * 100 + 5, float(v[i])) for i in x]
        if n > 50 and v.max() > v.min():
            v = (v - v.min()) / (v.max() - v.min())
            for width in range(3, n // 2 + 1, 2):
                w = v
                for _ in range(2):
                    w = np.array([np.mean([w[(i + j) % n] for j in range(-(width // 2), width // 2 + 1)]) for i in range(n)])
                w = w.round(12)
                high = [i for i in range(1, n - 1) if w[i - 1] < w[i] > w[i + 1]]
                low = [i for i in range(1, n - 1) if w[i - 1] > w[i] < w[i + 1]]
                if len(high) == len(low) == 1:
                    want[chrom] = (high[0] * 100, low[0] * 100)
                    break
            else:
                want[chrom] = (0, n * 50)
    coverage = spark.createDataFrame(rows, "sample string, chrom string, pos long, value double")
    chroms = spark.createDataFrame([("a", 6000), ("b", 9000), ("c", 3000), ("d", 7500)], "chrom string, length long")
    assert {r.chrom: (r.ori, r.ter) for r in oriter.coverage_ori_ter(coverage, chroms, 100).collect()} == want and len(want) == 2


def test_random_edits_equal_edits_of_single_bases(spark):
    import random

    rng = random.Random(2)
    layout, wanted, want = [], [], {}
    for k in range(40):
        genome = {}
        for chrom in "ab":
            pieces = [(chrom, i * 25, i * 25 + 25, rng.random() < 0.4) for i in range(4)]
            layout += [(f"s{k}", chrom, i, *p) for i, p in enumerate(pieces)]
            genome[chrom] = [(c, x, r) for c, a, b, r in pieces for x in (range(b - 1, a - 1, -1) if r else range(a, b))]
        for seq in range(rng.randint(1, 5)):
            chrom, src = rng.choice("ab"), rng.choice(["a", "b", None])
            op = rng.choice(["insert", "invert", "delete", "translocate", "duplicate"])
            of = genome[chrom if op in ("invert", "delete") else src or chrom]
            start = rng.randint(0, len(of))
            end = rng.randint(start, min(len(of), start + 40))
            pos, flip = rng.randint(0, len(genome[chrom])), rng.random() < 0.5
            if op == "translocate" and of is genome[chrom] and start < pos < end:
                pos = start
            wanted.append((f"s{k}", seq, op, chrom, pos, start, end, src if op != "insert" else "b", 10, 30, flip))
            turn = lambda part: [(c, x, not r) for c, x, r in reversed(part)]
            own, part = genome[chrom], of[start:end]
            if op == "insert":
                own[pos:pos] = turn([("b", x, False) for x in range(10, 30)]) if flip else [("b", x, False) for x in range(10, 30)]
            elif op == "invert":
                own[start:end] = turn(part)
            elif op == "delete":
                del own[start:end]
            else:
                part = turn(part) if flip else part
                if op == "translocate":
                    del of[start:end]
                    if of is own and start < pos:
                        pos -= end - start
                own[pos:pos] = part
        want |= {(f"s{k}", chrom): bases for chrom, bases in genome.items() if bases}
    kinds = "sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean"
    after = edits.apply_edits(
        spark.createDataFrame(layout, kinds),
        spark.createDataFrame(wanted, "sample string, seq int, op string, chrom string, pos long, start long, end long, src_chrom string, src_start long, src_end long, invert boolean"),
    )
    got = {}
    for r in sorted(after.collect(), key=lambda r: r.ord):
        span = range(r.end - 1, r.start - 1, -1) if r.is_reverse else range(r.start, r.end)
        got.setdefault((r.sample, r.chrom), []).extend((r.src_chrom, x, r.is_reverse) for x in span)
    assert got == want


def test_alike_samples_stand_side_by_side(spark):
    near = {("a", "c"): 0.9, ("b", "d"): 0.8, ("c", "e"): 0.85, ("a", "e"): 0.95}
    names = "abcde"
    rows = [(x, y, 1.0 if x == y else near.get((x, y), near.get((y, x), 0.1))) for x in names for y in names]
    got = similarity.cluster_order(spark.createDataFrame(rows, "sample_a string, sample_b string, scc double")).orderBy("place").collect()
    assert [(r.sample, r.cluster) for r in got] == [("a", 0), ("c", 0), ("e", 0), ("b", 1), ("d", 1)]
    same = spark.createDataFrame([(x, y, 1.0) for x in names for y in names], "sample_a string, sample_b string, scc double")
    assert {r.cluster for r in similarity.cluster_order(same).collect()} == {0}
    assert similarity.cluster_order(same.limit(0)).count() == 0
