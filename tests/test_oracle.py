"""Every query that has SQL gives the rows that DuckDB gives for it; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from contactloom.plans import fixtures

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def close(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert all(close(a, b) for a, b in zip(got, want))


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["sample", "chrom", "bin"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["m15_mask_white_lines", "a04_relative_insulation", "a07_candidate_borders", "s06_extract_track", "s09_track_window", "s14_coverage_ori_ter", "s15_recenter", "t02_extract_track_windows", "t06_pileup_mean", "w2_origins", "io3_read_cool_tables"])
def test_query_on_longer_genome(spark, duck, name, monkeypatch):
    monkeypatch.setattr(fixtures, "GROWTH", 5)
    assert fixtures.genome(spark, SF) == {"chr1": 128, "p1": 32}
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    result = duck.execute(entry.oracle_sql()[name].replace("// 100) AS k", "// 5) AS k"))
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))
