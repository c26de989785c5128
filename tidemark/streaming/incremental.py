"""The same questions over a stream of observations.

State is bounded by the grid, not by time: a baseline keeps three numbers per pixel and band, a merge by date keeps the dates
that the watermark has not closed. Classification against a frozen baseline has no state at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import baseline as base
from tidemark.operators.detect import Detector
from tidemark.operators.merge import month_days, poisoned_max

OBS_SCHEMA = "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double"


def read_observations(spark: SparkSession, path: str, schema: str = OBS_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Parquet files of observations as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def running_baseline(obs: DataFrame) -> DataFrame:
    """Update mode: the baseline of every pixel that a batch touches."""
    return base.fit(obs)


def classify(obs: DataFrame, detector: Detector, frozen: DataFrame) -> DataFrame:
    """Append mode, no state: each observation against a baseline table that does not change during the query."""
    return detector.detect(obs, frozen)


def daily(classified: DataFrame, delay: str = "7 days") -> DataFrame:
    """Append mode: one class per pixel and date, once no scene of that date can arrive any more.

    A late gap can turn a class into a gap, so a date is given out only when the watermark has closed it."""
    c = classified.withColumn("taken", F.col("obs_date").cast("timestamp")).withWatermark("taken", delay)
    out = c.groupBy(*base.PIXEL, F.window("taken", "1 day")).agg(poisoned_max().alias("cls"))
    return out.select(*base.PIXEL, F.col("window.start").cast("date").alias("obs_date"), "cls")


def monthly(dates: DataFrame) -> DataFrame:
    """Complete or update mode: flood days of each month so far, from a stream of merged dates."""
    return dates.groupBy(*base.PIXEL, F.date_format("obs_date", "yyyyMM").alias("ym")).agg(month_days().alias("flood_days"))


def newest_granules(items: DataFrame) -> DataFrame:
    """Update mode: the greatest processing stamp of each granule so far; of equals the greatest id, as a stream knows no order of arrival."""
    parts = F.split("scene_id", "_")
    many = F.size(parts) > 4
    i = items.select(F.when(many, F.get(parts, F.lit(3))).otherwise(F.col("scene_id")).alias("burst"), F.when(many, F.get(parts, F.lit(4))).otherwise(F.lit("")).alias("taken"), F.coalesce(F.get(parts, F.lit(5)), F.lit("")).alias("processed"), "scene_id")
    return i.groupBy("burst", "taken").agg(F.max(F.struct("processed", "scene_id")).alias("last")).select("burst", "taken", "last.scene_id")


def event_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Append mode: count and sum of values per type and window. events: event_type, ts, value."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy("event_type", w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def flood_sessions(dates: DataFrame, gap: str, delay: str = "30 days") -> DataFrame:
    """Append mode, an extra: flooded dates of a pixel with less than ``gap`` between them. Unlike runs of observations, gaps count in days."""
    d = dates.filter("cls = 3").withColumn("taken", F.col("obs_date").cast("timestamp")).withWatermark("taken", delay)
    s = d.groupBy(*base.PIXEL, F.session_window("taken", gap)).agg(F.count("*").alias("n_dates"))
    return s.select(*base.PIXEL, F.col("session_window.start").cast("date").alias("first"), "n_dates")


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Takes all that has arrived, batch by batch, and returns; started again on the same checkpoint it goes on from there."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_into(path: str, spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that folds a batch's observations into stored moments, each batch at most once.

    The state after a batch is a folder of its own, named by the batch; a batch that is run again after a failure writes the
    same folder from the same state before it. Older states go."""

    def write(batch: DataFrame, number: int) -> None:
        new = base.moments(batch)
        if number > 0:
            new = base.merge_moments(spark.read.parquet(f"{path}/state-{number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/state-{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state-{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return write


def store_into(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a folder for each batch (``<path>/*``), or one for the last where each batch is the whole result.

    A batch that is run again after a failure replaces its own folder, so no row is stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number if mode == 'append' else 'last'}")

    return write
