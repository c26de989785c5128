"""Flood classes as columns: 0 none, 1 VH only, 2 VV only, 3 both, NULL gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import BOTH, MONTH_NODATA


def anomaly(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; NULL where std is 0."""
    return (x - mean) / F.nullif(std, F.lit(0.0))


def is_low(x: Column, mean: Column, std: Column, threshold: float) -> Column:
    """Whether the anomaly is under the threshold, NULL where it is undefined.

    A deviation of 0 makes the anomaly minus or plus infinity, or undefined where x is the mean."""
    known = x.isNotNull() & mean.isNotNull() & std.isNotNull()
    flat = F.when(x < mean, F.lit(True)).when(x > mean, F.lit(False))
    return F.when(known & (std == 0), flat).when(known, anomaly(x, mean, std) < threshold)


def flood_class(vv_low: Column, vh_low: Column, gap_aware: bool = True) -> Column:
    """2 * VV + VH. A gap in either band is a gap, or counts as not low if not ``gap_aware``."""
    if not gap_aware:
        vv_low, vh_low = F.coalesce(vv_low, F.lit(False)), F.coalesce(vh_low, F.lit(False))
    return vv_low.cast("int") * 2 + vh_low.cast("int")


def slope_masked(cls: Column, slope: Column, limit: float) -> Column:
    """The class where the slope is under the limit, else 0: also over gaps, and where the slope is unknown."""
    return F.when(slope < limit, cls).otherwise(0)


def flood_days_bin(days: Column) -> Column:
    """0, 1-3, 4-7, 8+ as 0 to 3; NULL for no data."""
    return F.when(days == MONTH_NODATA, None).when(days == 0, 0).when(days <= 3, 1).when(days <= 7, 2).when(days.isNotNull(), 3)


def confidence(cls: Column) -> Column:
    return F.when(cls == BOTH, "high confidence").when(cls > 0, "low confidence").when(cls == 0, "not flooded")


def is_flooded(cls: Column) -> Column:
    """Class 3; false over gaps."""
    return F.coalesce(cls == BOTH, F.lit(False))


def any_class(cls: Column) -> Column:
    """Any class but 0; false over gaps."""
    return F.coalesce(cls > 0, F.lit(False))
