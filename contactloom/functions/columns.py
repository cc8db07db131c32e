"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that name a map, a track or a vector of scores.
KEY = ("sample", "chrom")


def null_if_nan(value: Column) -> Column:
    """NaN as null: a masked value."""
    return F.when(~F.isnan(value), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def middle(start: Column, end: Column) -> Column:
    """The middle of an interval, rounded down."""
    return F.floor((start + end) / 2)


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """How many positions two half-open intervals share; touching ones share none."""
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))


def circular_distance(a: Column, b: Column, length: Column) -> Column:
    """The shorter way between two positions of a circle."""
    d = F.pmod(a - b, length)
    return F.least(d, length - d)


def signed_offset(position: Column, origin: Column, length: Column) -> Column:
    """The shorter way from the origin to a position: from -length/2, exclusive, to length/2."""
    d = F.pmod(position - origin, length)
    return F.when(d * 2 > length, d - length).otherwise(d)


def unit_scale(unit: Column) -> Column:
    """The factor from base pairs to bp, kb, Mb or Gb, in any case; null for other units."""
    u = F.lower(F.trim(unit))
    return F.when(u == "bp", F.lit(1.0)).when(u == "kb", F.lit(1e-3)).when(u == "mb", F.lit(1e-6)).when(u == "gb", F.lit(1e-9))


def region_part(region: Column, part: str) -> Column:
    """chrom, start or end of a region written as chrom:start-end, thousands separators allowed; null if it isn't one."""
    pattern = r"^([^:]+):([0-9,]+)-([0-9,]+)$"
    group = {"chrom": 1, "start": 2, "end": 3}[part]
    found = F.when(region.rlike(pattern), F.regexp_extract(region, pattern, group))
    return found if part == "chrom" else F.regexp_replace(found, ",", "").cast("long")


def blob_kernel(a: Column, b: Column, s: int) -> Column:
    """The weight of cell (a, b) of a (2s+1) x (2s+1) window: highest where its axes through the centre meet."""
    x = 0.5 * (F.abs(a - b) + F.abs(2 * s - a - b)) / (2 * s)
    return F.exp(-0.5 * x * x) / F.sqrt(F.lit(2.0))


def span(lo: Column, hi: Column) -> Column:
    """lo to hi, both included, as an array; empty if hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
