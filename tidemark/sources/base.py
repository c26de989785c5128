"""What a source of scenes must offer, and two that read catalogs from storage that Spark can reach."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import DEM_MARGIN_DEG
from tidemark.functions import geo
from tidemark.operators import catalog as ops

Box = tuple[float, float, float, float]

#: An item collection in JSON, as catalogs publish it.
ITEMS = """features array<struct<id: string, collection: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>,
assets: map<string, struct<href: string>>, properties: map<string, string>>>"""


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item collections in JSON files as catalog rows: scene_id, collection, acquired, ring, minx..maxy, epsg, assets, properties, arrival."""
    raw = spark.read.schema(ITEMS).option("multiLine", True).json(path)
    i = raw.select(F.posexplode("features").alias("arrival", "i")).select("arrival", "i.*")
    i = i.withColumn("ring", geo.ring_of_pairs(F.get(F.col("geometry.coordinates"), F.lit(0)))).withColumn("_b", geo.ring_bounds(F.col("ring")))
    code = F.coalesce(F.regexp_extract(F.try_element_at("properties", F.lit("proj:code")), "([0-9]+)$", 1), F.try_element_at("properties", F.lit("proj:epsg")))
    return i.select(
        F.col("id").alias("scene_id"), "collection", F.try_to_timestamp(F.try_element_at("properties", F.lit("datetime"))).cast("timestamp_ntz").alias("acquired"), "ring",
        "_b.minx", "_b.miny", "_b.maxx", "_b.maxy",
        F.nullif(code, F.lit("")).cast("int").alias("epsg"), F.transform_values("assets", lambda _, a: a["href"]).alias("assets"), "properties", "arrival",
    )


def bare(href: str) -> str:
    """A link without its signature."""
    return href.split("?", 1)[0]


class SceneSource(ABC):
    """A connector: searches a catalog, names the assets of a scene, opens them."""

    dem_collection, dem_asset = "nasadem", "elevation"
    #: Whether a scene may be several rasters.
    several = False

    @abstractmethod
    def search(self, box: Box, start: str, end: str) -> DataFrame:
        """Scenes with both bands that meet the box, taken from start to end. The box is a hint that a source may ignore."""

    @abstractmethod
    def hrefs(self) -> tuple[Column, Column]:
        """Columns with the places of a scene's VV and VH rasters."""

    def rasters(self, scenes: DataFrame) -> DataFrame:
        """scene_id, obs_date, part (order among the scene's rasters), vv, vh (their places)."""
        vv, vh = self.hrefs()
        return scenes.select("scene_id", F.col("acquired").cast("date").alias("obs_date"), F.lit("").alias("part"), vv.alias("vv"), vh.alias("vh"))

    @abstractmethod
    def search_dem(self, box: Box) -> DataFrame:
        """Terrain items that meet the box."""

    def dem_href(self) -> Column:
        return F.try_element_at("assets", F.lit(self.dem_asset))

    def signing(self) -> Callable[[str], str]:
        """A function that makes a link which may be opened now, and that can travel to workers. An old signature is dropped before a new one is made."""
        return bare

    def sign(self, href: str) -> str:
        return self.signing()(href)


class SceneCatalog(SceneSource):
    """Scenes that are one raster per band."""

    def __init__(self, catalog: DataFrame, collection: str = "sentinel-1-rtc", vv: str = "vv", vh: str = "vh", dem: DataFrame | None = None, signer: Callable[[str], str] | None = None) -> None:
        self.catalog, self.collection, self.vv, self.vh = catalog, collection, vv, vh
        self.dem, self.signer = catalog if dem is None else dem, signer

    def search(self, box: Box, start: str, end: str) -> DataFrame:
        return ops.search(self.catalog, self.collection, box, start, end, (self.vv, self.vh))

    def hrefs(self) -> tuple[Column, Column]:
        return F.try_element_at("assets", F.lit(self.vv)), F.try_element_at("assets", F.lit(self.vh))

    def search_dem(self, box: Box) -> DataFrame:
        m = DEM_MARGIN_DEG
        return ops.search(self.dem, self.dem_collection, (box[0] - m, box[1] - m, box[2] + m, box[3] + m), assets=(self.dem_asset,))

    def signing(self) -> Callable[[str], str]:
        signer = self.signer
        return (lambda href: signer(bare(href))) if signer else bare


class BurstCatalog(SceneCatalog):
    """Scenes that are passes of many bursts, each of which may have been processed again."""

    several = True

    def __init__(self, catalog: DataFrame, collection: str = "OPERA_L2_RTC-S1_V1", vv: str = "0_VV", vh: str = "0_VH", dem: DataFrame | None = None) -> None:
        super().__init__(catalog, collection, vv, vh, dem)

    def bursts(self, box: Box, start: str, end: str) -> DataFrame:
        """Newest version of each burst."""
        return ops.newest(super().search(box, start, end))

    def search(self, box: Box, start: str, end: str) -> DataFrame:
        return ops.passes(self.bursts(box, start, end))

    def rasters(self, scenes: DataFrame) -> DataFrame:
        """A row per burst of each pass, in the order of its ids."""
        vv, vh = super().hrefs()
        places = self.catalog.filter(F.col("collection") == self.collection).select(F.col("scene_id").alias("part"), vv.alias("vv"), vh.alias("vh"))
        bursts = scenes.select("scene_id", F.to_date("acq", "yyyyMMdd").alias("obs_date"), F.explode("bursts").alias("part"))
        return bursts.join(places, "part").select("scene_id", "obs_date", "part", "vv", "vh")

    def hrefs(self) -> tuple[Column, Column]:
        raise NotImplementedError("a pass is many rasters; read its bursts and mosaic them")


def with_retry(read: Callable, href: str | Callable[[], str], attempts: int = 5, wait: float = 20.0, sleep: Callable[[float], None] = time.sleep):
    """read(href), tried again after waits that double; the href is made anew for each attempt if it is a function.

    The last error is raised. Meant for links; files on shared storage are read by Spark, whose tasks retry themselves."""
    for k in range(attempts):
        try:
            return read(href() if callable(href) else href)
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("attempts must be at least 1")
