"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Column, nodata: float | None = None) -> Column:
    """Missing pixel values (NaN, or the nodata tag) as NULL."""
    bad = F.isnan(value)
    if nodata is not None:
        bad = bad | (value == F.lit(float(nodata)))
    return F.when(~bad, value)


def window_start(year: Column, month: int = 6) -> Column:
    return F.make_date(year, F.lit(month), F.lit(1))


def window_end(year: Column, month: int = 8) -> Column:
    return F.last_day(F.make_date(year, F.lit(month), F.lit(1)))


def solar_day(ts: Column, lon: Column) -> Column:
    """Local solar date: UTC shifted by one hour per 15 degrees of longitude."""
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(ts) + F.round(lon * 240.0)))


def minmax(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def row_sum(cols: list[str]) -> Column:
    """Sum that skips nulls."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    return total


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson transform of ``x`` at parameter ``lam``."""
    two = F.lit(2.0)
    positive = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise(
        (F.pow(x + 1.0, lam) - 1.0) / lam
    )
    negative = F.when(F.abs(lam - two) < 1e-12, -F.log1p(-x)).otherwise(
        -(F.pow(-x + 1.0, two - lam) - 1.0) / (two - lam)
    )
    return F.when(x >= 0, positive).otherwise(negative)
