"""From classes per scene to dates, months and counts, each one aggregation on the pixel's key.

The grouping keys all begin with the pixel, so a table that is partitioned by it needs no further shuffle
on the way from scenes to months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import BOTH, MONTH_NODATA
from tidemark.functions.classes import slope_masked
from tidemark.functions.radiometry import both_valid
from tidemark.functions.text import month_tag
from tidemark.operators.baseline import PIXEL


def mask_slopes(classified: DataFrame, slope: DataFrame, limit: float) -> DataFrame:
    """Classes on slopes as 0; ``slope`` has aoi_id, px_row, px_col, slope_deg."""
    joined = classified.join(slope.select(*PIXEL, "slope_deg"), list(PIXEL), "left")
    return joined.select(*[c if c != "cls" else slope_masked(F.col("cls"), F.col("slope_deg"), limit).alias("cls") for c in classified.columns])


def poisoned_max(cls: str = "cls") -> Column:
    """The largest class, NULL if any is NULL."""
    return F.when(F.count("*") == F.count(cls), F.max(cls))


def by_date(classified: DataFrame) -> DataFrame:
    """One class per pixel and date: the largest of the date's scenes, a gap if any of them has one."""
    return classified.groupBy(*PIXEL, "obs_date").agg(poisoned_max().alias("cls"))


def season_max(dates: DataFrame) -> DataFrame:
    """The largest class of each pixel, gaps skipped."""
    return dates.groupBy(*PIXEL).agg(F.max("cls").alias("cls"))


def valid_scenes(obs: DataFrame) -> DataFrame:
    """How many scenes of each pixel are valid in both bands, before any mask."""
    return obs.groupBy(*PIXEL).agg(F.sum(both_valid(F.col("vv"), F.col("vh")).cast("int")).cast("long").alias("n_valid"))


def month_days() -> Column:
    """Dates of class 3; 255 without a valid date."""
    return F.when(F.count("cls") == 0, F.lit(MONTH_NODATA)).otherwise(F.count_if(F.col("cls") == BOTH)).cast("int")


def by_month(dates: DataFrame) -> DataFrame:
    """aoi_id, px_row, px_col, ym, flood_days."""
    return dates.groupBy(*PIXEL, month_tag(F.col("obs_date")).alias("ym")).agg(month_days().alias("flood_days"))


def months_wide(months: DataFrame, tags: list[str]) -> DataFrame:
    """A column m<yyyymm> per given month, in ascending order. The months are given, so no query must find them."""
    return months.groupBy(*PIXEL).pivot("ym", sorted(tags)).agg(F.first("flood_days")).select(*PIXEL, *[F.col(f"`{t}`").alias(f"m{t}") for t in sorted(tags)])


def flooded_pixels(classified: DataFrame, keys=("aoi_id", "scene_id")) -> DataFrame:
    """Pixels of class 3 and of no gap per scene."""
    return classified.groupBy(*keys).agg(F.count_if(F.col("cls") == BOTH).alias("n_flooded"), F.count("cls").alias("n_valid"))


def flooded_dates(dates: DataFrame) -> DataFrame:
    """Dates of class 3 per pixel."""
    return dates.groupBy(*PIXEL).agg(F.count_if(F.col("cls") == BOTH).alias("n_dates"))


def fraction_flooded(months: DataFrame, valid: DataFrame) -> DataFrame:
    """Flood days of the season over valid scenes; NULL without a valid scene or month."""
    days = months.groupBy(*PIXEL).agg(F.sum(F.when(F.col("flood_days") != MONTH_NODATA, F.col("flood_days"))).alias("days"))
    joined = days.join(valid, list(PIXEL), "left")
    return joined.select(*PIXEL, "days", "n_valid", (F.col("days") / F.nullif(F.col("n_valid"), F.lit(0)).cast("double")).alias("fraction"))
