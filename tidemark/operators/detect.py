"""Detectors: from observations to flood classes.

A detector maps (obs, baseline) to obs with a column ``cls``. Two come with the package; others subclass
``Detector``. Thresholds are literals of the plan, so mapping again with others reads the stored observations only.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DETECTOR_THRESHOLD, OTSU_BINS, OTSU_LEAST_VALID, PEAK_BINS, PEAK_ONE_IN, PEAK_WINDOW
from tidemark.functions.classes import flood_class, is_low
from tidemark.operators import baseline as base

SCENE = ("aoi_id", "scene_id")


class Detector(ABC):
    """``requires_baseline``: whether ``fit`` must run; ``requires_slope_mask``: whether classes on slopes go."""

    requires_baseline = True
    requires_slope_mask = True

    def fit(self, dry: DataFrame) -> DataFrame | None:
        """Baseline table of the dry season's observations, None if not needed."""
        return base.fit(dry) if self.requires_baseline else None

    @abstractmethod
    def detect(self, obs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        """``obs`` with ``cls``."""


class ZScore(Detector):
    """Flooded where the anomaly against the dry season is under a threshold, in either or both bands."""

    def __init__(self, vv: float = DETECTOR_THRESHOLD, vh: float = DETECTOR_THRESHOLD, gap_aware: bool = True) -> None:
        self.vv, self.vh, self.gap_aware = vv, vh, gap_aware

    def detect(self, obs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        if baseline is None:
            raise ValueError("the z-score detector needs a baseline")
        stats = baseline.select(*base.PIXEL, *[f"{b}_{s}" for b in base.BANDS for s in ("mean", "std")])
        low = {b: is_low(F.col(b), F.col(f"{b}_mean"), F.col(f"{b}_std"), t) for b, t in (("vv", self.vv), ("vh", self.vh))}
        joined = obs.join(stats, list(base.PIXEL), "left")  # a pixel without a baseline is a gap, not a loss
        return joined.select(*obs.columns, flood_class(low["vv"], low["vh"], self.gap_aware).alias("cls"))


class Otsu(Detector):
    """Flooded where a band is under its scene's own threshold, if its histogram has two peaks."""

    requires_baseline = False

    def __init__(self, scene=SCENE) -> None:
        self.scene = list(scene)

    def detect(self, obs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        cuts = otsu_thresholds(obs, self.scene)
        joined = obs.join(cuts.select(*self.scene, F.col("vv_threshold"), F.col("vh_threshold")), self.scene, "left")
        low = {b: F.when(F.col(b).isNotNull(), F.coalesce(F.col(b) < F.col(f"{b}_threshold"), F.lit(False))) for b in base.BANDS}
        return joined.select(*obs.columns, flood_class(low["vv"], low["vh"]).alias("cls"))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal-width bin; the highest value belongs to the last."""
    return F.least(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * float(bins)), F.lit(bins - 1)).cast("int")


def _dense(bins: Column) -> Column:
    """``bins`` counts from the map ``hist``."""
    return F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.coalesce(F.try_element_at("hist", i), F.lit(0).cast("long")))


def is_bimodal(counts: Column) -> Column:
    """Whether at least two bins of the smoothed counts are higher than both neighbours and a twentieth of the highest.

    Smoothing sums a window with the ends repeated; beyond the ends there is nothing."""
    half, n = PEAK_WINDOW // 2, PEAK_BINS
    at = lambda i: F.element_at(counts, F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)) + 1)
    smooth = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sum((at(i + k) for k in range(-half + 1, half + 1)), at(i - half)))

    def peaks(s: Column) -> Column:
        side = lambda i: F.coalesce(F.get(s, i), F.lit(0).cast("long"))
        own = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.get(s, i) > side(i - 1)) & (F.get(s, i) > side(i + 1)) & (F.get(s, i) * PEAK_ONE_IN >= F.array_max(s)))
        return F.size(own) >= 2

    # transform over a one-element array names the smoothed counts, so that they are computed once.
    return F.element_at(F.transform(F.array(smooth), peaks), 1)


def otsu_split(counts: Column, bins: int = OTSU_BINS) -> Column:
    """Number of the bin after which splitting separates the two sides best; the first of equals.

    Sums are kept in whole bins, so the choice does not depend on the order of summation."""
    weighted = F.transform(counts, lambda c, i: c * i)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    moment = F.aggregate(weighted, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("m"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"), total.alias("n"), moment.alias("s"))

    def step(a: Column, c: Column) -> Column:
        w, m = a["w"] + c, a["m"] + c * a["i"]
        rest = F.nullif(a["n"] - w, F.lit(0).cast("long"))
        gap = m / F.nullif(w, F.lit(0).cast("long")).cast("double") - (a["s"] - m) / rest.cast("double")
        value = F.coalesce(w.cast("double") * rest * gap * gap, F.lit(-1.0))
        better = value > a["best"]
        return F.struct(w.alias("w"), m.alias("m"), F.when(better, value).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"), a["n"].alias("n"), a["s"].alias("s"))

    return F.aggregate(counts, start, step)["at"]


def otsu_thresholds(obs: DataFrame, scene=SCENE) -> DataFrame:
    """A row per scene: valid pixels, whether bimodal, and threshold of each band.

    The threshold is NULL with under 100 valid pixels, a constant band, a histogram without two peaks, or a
    side without pixels. Histograms are counted before they are shuffled; a scene's are two short arrays."""
    scene = list(scene)
    bands = list(base.BANDS)
    ends = obs.groupBy(*scene).agg(*[f(b).alias(f"{b}_{name}") for b in bands for f, name in ((F.count, "n"), (F.min, "low"), (F.max, "high"))])
    # One count of pairs of bins for both bands, without a row more per pixel; a scene has 2^16 pairs at most.
    bin_of = lambda b: F.when(F.col(b).isNotNull() & (F.col(f"{b}_high") > F.col(f"{b}_low")), _bin(F.col(b), F.col(f"{b}_low"), F.col(f"{b}_high"), OTSU_BINS)).alias(f"{b}_bin")
    pairs = obs.join(ends, scene).select(*scene, *map(bin_of, bands)).groupBy(*scene, *[f"{b}_bin" for b in bands]).agg(F.count("*").alias("n"))
    sides = pairs.select(*scene, "n", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_bin").alias("bin")) for b in bands])).alias("s")).filter("s.bin is not null")
    counted = sides.groupBy(*scene, "s.band", "s.bin").agg(F.sum("n").alias("n"))
    tables = counted.groupBy(*scene, "band").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("hist"))
    # As columns of their own the counts are made once and not for each use. A coarse bin is so many fine ones.
    dense = tables.select(*scene, "band", _dense(F.lit(OTSU_BINS)).alias("fine"))
    width = OTSU_BINS // PEAK_BINS
    coarse = F.transform(F.sequence(F.lit(0), F.lit(PEAK_BINS - 1)), lambda i: F.aggregate(F.slice("fine", i * width + 1, F.lit(width)), F.lit(0).cast("long"), lambda x, y: x + y))
    dense = dense.select(*scene, "band", "fine", coarse.alias("coarse"))
    verdict = dense.select(*scene, "band", is_bimodal(F.col("coarse")).alias("two"), otsu_split(F.col("fine")).alias("at"))
    per = verdict.groupBy(*scene).agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}") for b in bands for c in ("two", "at")])
    out = ends.join(per, scene, "left")
    for b in bands:
        low, high = F.col(f"{b}_low"), F.col(f"{b}_high")
        cut = low + (F.col(f"{b}_at") + 0.5) * ((high - low) / float(OTSU_BINS))
        fit = (F.col(f"{b}_n") >= OTSU_LEAST_VALID) & F.col(f"{b}_two") & (low < cut) & (high >= cut)
        out = out.withColumn(f"{b}_threshold", F.when(fit, cut)).withColumn(f"{b}_bimodal", F.coalesce(f"{b}_two", F.lit(False)))
    return out.select(*scene, *[f"{b}_{c}" for b in bands for c in ("n", "bimodal", "threshold")])
