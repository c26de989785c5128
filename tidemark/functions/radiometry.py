"""Map algebra on backscatter columns. A gap is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import FLOAT32_MAX, NODATA_DB


def no_nan(x: Column) -> Column:
    """NaN as NULL; for columns that come from rasters."""
    return F.when(~F.isnan(x), x)


def scrub(x: Column) -> Column:
    """Gap markers of stored baselines as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < FLOAT32_MAX), x)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def linear_to_decibel(x: Column) -> Column:
    """10 log10 x; NULL where x is not positive."""
    return F.log10(positive(x)) * 10.0


def decibel_to_linear(d: Column) -> Column:
    return F.pow(F.lit(10.0), d / 10.0)


def below_nodata(db: Column, limit: float = NODATA_DB) -> Column:
    """Keeps decibels under the limit, band by band."""
    return F.when(~F.isnan(db) & (db < limit), db)


def calibrated(linear: Column, limit: float = NODATA_DB) -> Column:
    """Linear power as decibels with every gap NULL."""
    return below_nodata(linear_to_decibel(no_nan(linear)), limit)


def both_valid(vv: Column, vh: Column) -> Column:
    return vv.isNotNull() & vh.isNotNull()


def fill(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def stretched(x: Column, low: Column, high: Column) -> Column:
    """x between low and high as 0 to 1; 0 where the range is degenerate."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(x.isNotNull(), F.when(high > low, inside).otherwise(0.0))


def ratio(vv_mean: Column, vh_mean: Column) -> Column:
    """vv / vh; 0 where vh is 0."""
    return F.when(vh_mean == 0, F.lit(0.0)).otherwise(vv_mean / F.nullif(vh_mean, F.lit(0.0)))
