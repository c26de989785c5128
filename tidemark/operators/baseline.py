"""Dry-season baselines: per-pixel mean and population deviation of each band, gaps skipped.

Both aggregates keep central moments, combine on the map side and merge exactly, so one shuffle of partial
states fits the whole archive. ``moments``, ``merge_moments`` and ``finish`` keep that state as a table, which
new scenes are folded into without reading the old ones again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("aoi_id", "px_row", "px_col")
BANDS = ("vv", "vh")


def fit(obs: DataFrame, keys=PIXEL, bands=BANDS) -> DataFrame:
    """keys, ``<band>_mean``, ``<band>_std``, ``n_<band>`` of every pixel that was seen at all."""
    stats = [f(F.col(b)).alias(name.format(b)) for b in bands for f, name in ((F.avg, "{}_mean"), (F.stddev_pop, "{}_std"), (F.count, "n_{}"))]
    return obs.groupBy(*keys).agg(*stats)


def moments(obs: DataFrame, keys=PIXEL, bands=BANDS) -> DataFrame:
    """keys and a struct (n, mean, m2) per band: the state that merges."""
    state = lambda b: F.struct(F.count(b).alias("n"), F.coalesce(F.avg(b), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(b) * F.count(b), F.lit(0.0)).alias("m2"))
    return obs.groupBy(*keys).agg(*[state(b).alias(b) for b in bands])


def merged(a: Column, b: Column) -> Column:
    """Two states as one."""
    n = a["n"] + b["n"]
    all_ = F.nullif(n, F.lit(0)).cast("double")
    delta = b["mean"] - a["mean"]
    mean = F.coalesce(a["mean"] + delta * b["n"] / all_, F.lit(0.0))
    m2 = F.coalesce(a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / all_, F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def empty_state() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))


def merge_moments(old: DataFrame, new: DataFrame, keys=PIXEL, bands=BANDS) -> DataFrame:
    """State over the scenes of both tables; each has a row per pixel."""
    a, b = old.select(*keys, *[F.col(x).alias(f"_a_{x}") for x in bands]), new.select(*keys, *[F.col(x).alias(f"_b_{x}") for x in bands])
    both = a.join(b, list(keys), "full_outer")
    return both.select(*keys, *[merged(F.coalesce(F.col(f"_a_{x}"), empty_state()), F.coalesce(F.col(f"_b_{x}"), empty_state())).alias(x) for x in bands])


def finish(state: DataFrame, keys=PIXEL, bands=BANDS) -> DataFrame:
    """The same columns as ``fit``."""

    def of(b: str) -> list[Column]:
        n = F.nullif(F.col(b)["n"], F.lit(0))
        return [F.when(n.isNotNull(), F.col(b)["mean"]).alias(f"{b}_mean"), F.sqrt(F.col(b)["m2"] / n).alias(f"{b}_std"), F.col(b)["n"].alias(f"n_{b}")]

    return state.select(*keys, *[c for b in bands for c in of(b)])


def fold(parts: list[DataFrame], keys=PIXEL, bands=BANDS) -> DataFrame:
    """The baseline of several tables of observations, each aggregated on its own."""
    return finish(reduce(lambda a, b: merge_moments(a, b, keys, bands), [moments(p, keys, bands) for p in parts]), keys, bands)
