"""Runs of flooded observations: the longest, and how many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.classes import is_flooded
from tidemark.operators.baseline import PIXEL


def flood_runs(dates: DataFrame, flooded: Callable[[Column], Column] = is_flooded) -> DataFrame:
    """aoi_id, px_row, px_col, max_run, n_events over the observed dates of each pixel, in order.

    A run ends at the next date that is not flooded; days without an observation do not end it. One sort by
    pixel and date serves both windows and both aggregations."""
    by_pixel = Window.partitionBy(*PIXEL)
    order = by_pixel.orderBy("obs_date")
    d = dates.withColumn("wet", flooded(F.col("cls")).cast("int"))
    d = d.withColumn("island", F.sum(1 - F.col("wet")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*PIXEL, "island").agg(F.sum("wet").alias("run"))
    return runs.groupBy(*PIXEL).agg(F.max("run").alias("max_run"), F.count_if(F.col("run") > 0).alias("n_events"))
