"""Areas, totals, agreement between products, and the numbers behind maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BOTH, CELL_SIZE, MONTH_NODATA
from tidemark.functions.radiometry import stretched
from tidemark.operators.baseline import PIXEL


def _km2(cell: float) -> float:
    return cell * cell / 1e6


def area_by_year(months: DataFrame, cell: float = CELL_SIZE, keys=("aoi_id",)) -> DataFrame:
    """Pixels flooded on at least one day of a year, and their area in km2."""
    hit = F.col("flood_days").between(1, MONTH_NODATA - 1)
    pixel = months.groupBy(*keys, *[k for k in PIXEL if k not in keys], F.substring("ym", 1, 4).alias("year")).agg(F.bool_or(hit).alias("hit"))
    out = pixel.groupBy(*keys, "year").agg(F.count_if("hit").alias("n_pixels"))
    return out.withColumn("area_km2", F.col("n_pixels") * F.lit(_km2(cell)))


def year_totals(months: DataFrame) -> DataFrame:
    """Flood days of each pixel and year over its valid months; NULL if it has none."""
    return months.groupBy(*PIXEL, F.substring("ym", 1, 4).alias("year")).agg(F.sum(F.when(F.col("flood_days") != MONTH_NODATA, F.col("flood_days"))).alias("flood_days"))


def area_rollup(months: DataFrame, cell: float = CELL_SIZE) -> DataFrame:
    """Flooded pixel-months, flood days and area by area and month, by area, and over all."""
    wet = F.col("flood_days").between(1, MONTH_NODATA - 1)
    out = months.rollup("aoi_id", "ym").agg(F.count_if(wet).alias("n_pixels"), F.sum(F.when(wet, F.col("flood_days")).otherwise(0)).alias("flood_days"), F.grouping_id().alias("level"))
    return out.withColumn("area_km2", F.col("n_pixels") * F.lit(_km2(cell)))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per month that both products have: pixels valid in both and in either, shares (in percent) that are equal
    and that differ by one day at most, mean and deviation of a - b. Both have aoi_id, px_row, px_col, ym, flood_days."""
    day = lambda c: F.when(F.col(c) != MONTH_NODATA, F.col(c))
    left = a.select(*PIXEL, "ym", F.lit(1).alias("in_a"), day("flood_days").alias("a"))
    right = b.select(*PIXEL, "ym", F.lit(1).alias("in_b"), day("flood_days").alias("b"))
    j = left.join(right, [*PIXEL, "ym"], "full_outer").withColumn("d", (F.col("a") - F.col("b")).cast("double"))
    both = F.nullif(F.count("d"), F.lit(0)).cast("double")
    out = j.groupBy("ym").agg(
        F.count("d").alias("n_both"),
        F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("n_either"),
        (F.count_if(F.col("d") == 0) * 100.0 / both).alias("exact_pct"),
        (F.count_if(F.abs("d") <= 1) * 100.0 / both).alias("within_one_pct"),
        F.avg("d").alias("mean_diff"),
        F.stddev_pop("d").alias("std_diff"),
        F.count("in_a").alias("rows_a"),
        F.count("in_b").alias("rows_b"),
    )
    return out.filter("rows_a > 0 and rows_b > 0").drop("rows_a", "rows_b")


def clip_limits(obs: DataFrame, columns: list[str], keys: list[str], low: float = 0.02, high: float = 0.98, exact: bool = False) -> DataFrame:
    """``<column>_low`` and ``_high``: interpolated percentiles of the values there are, 0 and 1 if there is none.

    Percentiles are of rank within 1 in 10000, from a bounded summary; ``exact`` interpolates, and keeps a count of each distinct
    value of a group, so it is for groups of few values."""
    f = (lambda c: F.percentile(c, F.array(F.lit(low), F.lit(high)))) if exact else (lambda c: F.percentile_approx(c, [low, high], 10000))
    out = obs.groupBy(*keys).agg(*[f(F.col(c)).alias(c) for c in columns])
    at = lambda c, i, d: F.coalesce(F.get(F.col(c), F.lit(i)).cast("double"), F.lit(d))
    return out.select(*keys, *[x for c in columns for x in (at(c, 0, 0.0).alias(f"{c}_low"), at(c, 1, 1.0).alias(f"{c}_high"))])


def composite(obs: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """red, green, blue from vv, vh and vv - vh in decibels, each stretched between its 2nd and 98th percentile of a scene."""
    c = obs.withColumns({"red": F.col("vv"), "green": F.col("vh"), "blue": F.col("vv") - F.col("vh")})
    bands = ["red", "green", "blue"]
    j = c.join(clip_limits(c, bands, keys, exact=exact), keys)
    return j.select(*obs.columns, *[stretched(F.col(b), F.col(f"{b}_low"), F.col(f"{b}_high")).alias(b) for b in bands])


def peak_date(dates: DataFrame) -> DataFrame:
    """The date with most pixels of class 3 in each area; the earlier of equals."""
    n = dates.groupBy("aoi_id", "obs_date").agg(F.count_if(F.col("cls") == BOTH).alias("n_flooded"))
    w = Window.partitionBy("aoi_id").orderBy(F.col("n_flooded").desc(), "obs_date")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
