"""Queries on small tables made for them, whose rows are few or equal where those of the given tables are not, against their SQL."""

import duckdb

import __spark_entry__ as entry
from .test_oracle import close, rows_of

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, **tables):
    """Whether the query and its SQL give the same rows on these tables, each a statement of DuckDB; gives the rows."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    assert sorted(columns) == sorted(df.columns) and len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))
    return [dict(zip(sorted(columns), r)) for r in got]


def events(values):
    """One value for each bin of 1000 positions."""
    rows = ", ".join(f"({k}, {v})" for k, v in enumerate(values))
    # The event whose position is the bin's first one.
    return f"select (k * 1000 * 44973 % 64000)::bigint as event_id, 'x' as event_type, v::double as value from (values {rows}) t(k, v) where k * 1000 * 44973 % 64000 * 37 % 64000 = k * 1000"


def test_contacts_that_a_profile_does_not_see_are_no_zeros(spark, tmp_path):
    got = same(spark, tmp_path, "a20_fourc_like", supplier=f"from '{SF}/supplier.parquet'", lineitem=f"from '{SF}/lineitem.parquet' limit 120")
    assert any(r["val"] is None for r in got) and any(r["val"] for r in got)


def test_a_value_just_so_many_deviations_away_stays(spark):
    from contactloom.operators import tracks

    # Median 46.49, deviation 13.98; the last digits of 25.52 as a mean of seven values in another order.
    values = [46.49, 46.49 - 13.98, 46.49 + 13.98, 25.519999999999996, 1000.0, 46.0, 47.0, 46.49 + 20, 1.0]
    track = spark.createDataFrame([("s", "c", k, v) for k, v in enumerate(values)], "sample string, chrom string, bin long, value double")
    found = tracks.mad(track, "value").first()
    assert round(found["median"], 9) == 46.49 and round(found["mad"], 9) == 13.98
    got = {r.bin for r in tracks.remove_nmad(track, 1.5).where("value is not null").collect()}
    assert got == {0, 1, 2, 3, 5, 6, 7}


def test_a_plateau_is_no_strict_peak(spark, tmp_path):
    got = same(spark, tmp_path, "s01_find_peaks", supplier="select 1 as s_suppkey", events=events([1, 5, 1, 7, 7, 2, 3, 1]))
    assert {r["bin"] for r in got} == {1, 6}
