"""The whole flood-mapping run over tables: areas, scenes, observations, baseline, slope, classes, dates, months.

Nothing here moves pixels through the driver: each stage is one plan that ends in a partitioned table, and a stage
skips the areas whose partition is there already. Thresholds are parameters of ``map_floods``, so mapping
again with others reads stored observations and baselines only.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import CELL_SIZE, DRY_MONTH_PLACEHOLDER, SLOPE_BUFFER_M, SLOPE_LIMIT, STAGE_THRESHOLD
from tidemark.functions import geo
from tidemark.functions.text import contiguous_years, season_tag
from tidemark.operators import baseline as base
from tidemark.operators import catalog, merge, neighbourhood, tiles, vectorise
from tidemark.operators.detect import Detector, Otsu, ZScore
from tidemark.sources import geopackage
from tidemark.sources.base import SceneSource
from tidemark.sources.reader import DEM_LEVEL, SCENE_LEVEL, SceneReader, grids
from tidemark.sources.store import Store, parse_config, read_areas

DETECTORS: dict[str, Callable[[], Detector]] = {"zscore": ZScore, "otsu": Otsu}


@dataclass
class Config:
    """Settings of a run; every one has a default but the folder."""

    root: str
    aoi_ids: list[int] | None = None
    area: object = None
    grid_mode: str = "mgrs"
    tile_km: float | None = None
    dry_month: str | None = None
    dry_years: list[int] = field(default_factory=lambda: list(range(2015, 2021)))
    wet: tuple[str, str] = ("2020/07", "2020/09")
    detector: str = "zscore"
    cell: float = CELL_SIZE
    vv_thd: float = STAGE_THRESHOLD
    vh_thd: float = STAGE_THRESHOLD
    slope_thd: float = SLOPE_LIMIT
    smooth: bool = False
    smooth_size: int = 3
    polygons: bool = False
    scene_level: int | None = SCENE_LEVEL
    dem_level: int | None = DEM_LEVEL

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From a parsed file; an old name of the slope limit is taken with a warning, unknown names are an error."""
        s = dict(settings)
        if "rel_slope_thd" in s:
            old = s.pop("rel_slope_thd")
            if s.get("slope_thd") is None:
                warnings.warn("rel_slope_thd is called slope_thd now", DeprecationWarning, stacklevel=2)
                s["slope_thd"] = old
        unknown = set(s) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: v for k, v in s.items() if v is not None})

    @property
    def years(self) -> list[int]:
        return contiguous_years(self.dry_years)

    @property
    def tag(self) -> str:
        return season_tag(self.dry_years, list(self.wet))

    @property
    def dry_tag(self) -> str:
        """Names what a baseline is fitted on and how: dry years, detector, cell. Another setting is another baseline."""
        return f"DRY_{'_'.join(map(str, sorted(set(self.years))))}_{self.detector}_{self.cell:g}"


class FloodRun:
    """Stages of one run. ``read`` turns (scenes, areas) into observations on the pixel grid; it is only called for what is not stored.
    Where a source is given and no ``read``, a ``SceneReader`` reads its files, and terrain too."""

    def __init__(self, spark: SparkSession, config: Config, areas: DataFrame | None = None, source: SceneSource | None = None, read: Callable[[DataFrame, DataFrame], DataFrame] | None = None, detector: Detector | None = None) -> None:
        if config.detector not in DETECTORS and detector is None:
            raise ValueError(f"no detector {config.detector!r}; there are {', '.join(DETECTORS)}")
        if areas is None and config.area is None:
            raise ValueError("a run needs areas or an area of interest")
        if areas is None:
            if config.dry_month is None:
                raise ValueError("an area of interest needs dry_month")
            areas = tiles.generate(spark, config.area, config.grid_mode, config.tile_km).withColumn("dry_month", F.lit(config.dry_month))
            areas = areas.withColumn("_b", geo.ring_bounds(F.col("ring"))).select("*", "_b.*").drop("_b")
        if config.aoi_ids is not None:
            areas = areas.filter(F.col("aoi_id").isin(list(config.aoi_ids)))
        if read is None and source is not None:
            read = SceneReader(spark, source, config.cell, config.scene_level, config.dem_level)
        self.spark, self.config, self.areas, self.source, self.read = spark, config, areas, source, read
        self.detector = detector or DETECTORS[config.detector]()
        self.store = Store(spark, config.root)

    def is_done(self, aoi_id: int) -> bool:
        """Whether the area's months are stored for these dry years and this season."""
        return aoi_id in self.store.areas_done("months", self.config.tag)

    def open_areas(self, table: str, tag: str | None = None) -> DataFrame:
        return self.areas.filter(~F.col("aoi_id").isin(self.store.areas_done(table, tag)))

    def dry_ranges(self) -> DataFrame:
        """year, first, last over the areas whose baseline is missing; no rows if none is."""
        rest = self.open_areas("baseline", self.config.dry_tag)
        unset = rest.filter(F.col("dry_month") == DRY_MONTH_PLACEHOLDER).limit(1).count()
        if unset:
            raise ValueError("dry_month of some areas is still a placeholder")
        return catalog.dry_window(rest, self.config.years)

    def scenes(self, ranges: list[tuple[str, str]], areas: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scenes of the given spans, each once, and area-scene pairs: one search over the box around all areas."""
        if self.source is None:
            raise ValueError("a run without a source works on stored observations only")
        box = catalog.union_box(areas).first()
        found = None
        for first, last in ranges:
            part = self.source.search((box["minx"], box["miny"], box["maxx"], box["maxy"]), first, last)
            found = part if found is None else found.unionByName(part)
        found = found.dropDuplicates(["scene_id"])
        return found, catalog.match(areas, found)

    def store_observations(self, ranges: list[tuple[str, str]], areas: DataFrame) -> None:
        """Reads scenes that some area lacks, and stores observations per area and scene."""
        found, pairs = self.scenes(ranges, areas)
        lacking = pairs.join(self.store.scenes_done(), ["aoi_id", "scene_id"], "left_anti")
        if lacking.isEmpty():
            return
        obs = self.read(found.join(lacking.select("scene_id").distinct(), "scene_id", "left_semi"), areas)
        self.store.write("obs", obs.join(lacking, ["aoi_id", "scene_id"], "left_semi"), ("px_row", "px_col"))

    def prepare_baseline(self) -> None:
        if not self.detector.requires_baseline:
            return
        rest = self.open_areas("baseline", self.config.dry_tag)
        ranges = self.dry_ranges().collect()  # a row per year
        if not ranges:
            return
        if self.source is not None:
            self.store_observations([(str(r["first"]), str(r["last"])) for r in ranges], rest)
        span = [F.col("obs_date").between(F.lit(r["first"]), F.lit(r["last"])) for r in ranges]
        dry = span[0]
        for s in span[1:]:
            dry = dry | s
        obs = self.store.read("obs").filter(dry).join(rest.select("aoi_id"), "aoi_id", "left_semi")
        self.store.write("baseline", self.detector.fit(obs).withColumn("tag", F.lit(self.config.dry_tag)), ("px_row", "px_col"))

    def baseline(self) -> DataFrame:
        """Stored baselines of these dry years, this detector and cell."""
        return self.store.read("baseline").filter(F.col("tag") == self.config.dry_tag).drop("tag")

    def prepare_slope(self, dem: DataFrame | None = None) -> None:
        """``dem``: aoi_id, px_row, px_col, elev, with rows and columns also in the margin around the tile, if there is one. Without it
        terrain is searched for and read, and the slopes of the margin are left out."""
        rest = self.open_areas("slope")
        if dem is None:
            if rest.isEmpty():
                return
            dem = self.read.terrain(rest, SLOPE_BUFFER_M)
        own = dem.join(rest.select("aoi_id"), "aoi_id", "left_semi").withColumn("elev", F.coalesce("elev", F.lit(0.0)))
        slopes = neighbourhood.slope(own, self.config.cell)
        if isinstance(self.read, SceneReader):
            size = grids(rest, self.config.cell).select("aoi_id", "n_rows", "n_cols")
            slopes = slopes.join(size, "aoi_id").filter("px_row between 0 and n_rows - 1 and px_col between 0 and n_cols - 1").drop("n_rows", "n_cols")
        self.store.write("slope", slopes, ("px_row", "px_col"))

    @property
    def dem_margin(self) -> int:
        """Pixels of terrain wanted on each side of a tile."""
        return int(SLOPE_BUFFER_M // self.config.cell) + 1

    def wet_span(self) -> tuple[str, str]:
        """First day of the first and last day of the last month."""
        import calendar

        (y0, m0), (y1, m1) = (map(int, m.split("/")) for m in self.config.wet)
        return f"{y0:04d}-{m0:02d}-01", f"{y1:04d}-{m1:02d}-{calendar.monthrange(y1, m1)[1]:02d}"

    def wet_observations(self) -> DataFrame:
        first, last = self.wet_span()
        return self.store.read("obs").filter(F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(self.areas.select("aoi_id"), "aoi_id", "left_semi")

    def prepare_wet(self) -> None:
        if self.source is not None:
            self.store_observations([self.wet_span()], self.areas)

    def map_floods(self, vv_thd: float | None = None, vh_thd: float | None = None, slope_thd: float | None = None, smooth: bool | None = None) -> DataFrame:
        """Classes of the wet season: detect, mask slopes, smooth. The detector itself is not changed."""
        c = self.config
        detector = self.detector
        if isinstance(detector, ZScore):
            detector = ZScore(c.vv_thd if vv_thd is None else vv_thd, c.vh_thd if vh_thd is None else vh_thd, detector.gap_aware)
        stored = self.baseline() if detector.requires_baseline else None
        out = detector.detect(self.wet_observations(), stored).drop("vv", "vh")
        if detector.requires_slope_mask:
            out = merge.mask_slopes(out, self.store.read("slope"), c.slope_thd if slope_thd is None else slope_thd)
        if c.smooth if smooth is None else smooth:
            out = neighbourhood.majority(out, c.smooth_size)
        return out

    def finish(self, classes: DataFrame) -> None:
        """Stores dates, months, valid counts and, if wanted, polygons."""
        tag = F.lit(self.config.tag)
        pixel = ("px_row", "px_col")
        self.store.write("classes", classes.withColumn("tag", tag), pixel)
        classes = self.store.read("classes").filter(F.col("tag") == self.config.tag).drop("tag").join(self.areas.select("aoi_id"), "aoi_id", "left_semi")
        self.store.write("dates", merge.by_date(classes).withColumn("tag", tag), pixel)
        self.store.write("valid", merge.valid_scenes(self.wet_observations()).withColumn("tag", tag), pixel)
        if self.config.polygons:
            self.store.write("polygons", vectorise.regions(classes, self.config.cell).withColumn("tag", tag))
        dates = self.store.read("dates").filter(F.col("tag") == self.config.tag)
        self.store.write("months", merge.by_month(dates).withColumn("tag", tag), pixel)  # last: its partition says done

    def run(self, dem: DataFrame | None = None) -> DataFrame:
        """All stages for the areas that are not done; the months of all areas."""
        self.areas = self.open_areas("months", self.config.tag)
        if not self.areas.isEmpty():
            self.prepare_baseline()
            if self.detector.requires_slope_mask and (dem is not None or isinstance(self.read, SceneReader)):
                self.prepare_slope(dem)
            self.prepare_wet()
            self.finish(self.map_floods())
        return self.store.read("months").filter(F.col("tag") == self.config.tag)


def run_one_aoi(spark: SparkSession, settings: dict | str, aoi_id: int, source: SceneSource | None = None, areas: DataFrame | None = None, dem: DataFrame | None = None) -> DataFrame:
    """The whole run for one area, as a batch job calls it: ``settings`` are those of a configuration file, or its text. The months of the area.

    Areas come from ``areas``, from the file that the setting ``grid`` names, or are made over the setting ``area``."""
    s = dict(parse_config(settings) if isinstance(settings, str) else settings)
    grid = s.pop("grid", None)
    if areas is None and grid is not None:
        areas = geopackage.read(spark, grid) if grid.endswith(".gpkg") else read_areas(spark, grid)
    config = Config.of(s | {"aoi_ids": [aoi_id]})
    run = FloodRun(spark, config, areas, source)
    return run.run(dem).filter(F.col("aoi_id") == aoi_id)
