"""From scenes and terrain in files to rows on the pixel grids of areas, without a callback.

A row of work is an area, a raster of a scene and a band of the area's pixel rows. A worker projects the band's pixels into the
raster's coordinates, fetches the header and those blocks of the file that the band meets (of an overview, if one is asked
for), turns power into decibels with every gap NULL, and interpolates. So nothing is shuffled but rows of work, the
memory of a task is one band with its window, and a lost task reads its window again. Pixels further than half
a source pixel outside a raster are gaps; within that margin the edge counts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import CELL_SIZE, NODATA_DB
from tidemark.functions import geo
from tidemark.operators import catalog, regrid
from tidemark.sources import base, geotiff
from tidemark.sources.base import SceneSource

#: Pixel rows of an area that one row of work reads.
BAND_ROWS = 256
#: Overview that scenes are read at, as the number of the overview; None is full size.
SCENE_LEVEL = 3
DEM_LEVEL = 1


def grids(areas: DataFrame, cell: float = CELL_SIZE, buffer: float = 0.0) -> DataFrame:
    """aoi_id, utm_zone, south, xmin, ymax, n_rows, n_cols of areas (aoi_id, zone such as 45R, and ring or minx..maxy in degrees).

    With a buffer, ``margin`` pixels are wanted on each side: their rows and columns are negative or beyond the area's."""
    code = geo.zone_to_epsg(F.col("zone"))
    ring = F.col("ring") if "ring" in areas.columns else geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    t = areas.select("aoi_id", (code % 100).alias("utm_zone"), (code >= 32700).alias("south"), ring.alias("ring"))
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / float(cell)).cast("int")
    margin = F.lit(int(buffer // cell) + 1 if buffer else 0)
    return regrid.tile_bounds(t).select("aoi_id", "utm_zone", "south", "xmin", "ymax", n("ymin", "ymax").alias("n_rows"), n("xmin", "xmax").alias("n_cols"), margin.alias("margin"))


def _projected(x: np.ndarray, y: np.ndarray, zone: int, south: bool, epsg: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Metres in an area's zone as coordinates of a raster. A raster that does not say its system is in the area's."""
    if epsg in (None, 32767, (32700 if south else 32600) + zone):
        return x, y
    if epsg != 4326 and not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG:{epsg} is neither UTM nor degrees")
    p = geo.evaluate(geo.utm_inverse("x", "y", "zone", "south"), zone, south, x=x, y=y)
    if epsg == 4326:
        return p["lon"], p["lat"]
    q = geo.evaluate(geo.utm_forward("lon", "lat", "zone", "south"), epsg % 100, epsg >= 32700, lon=p["lon"], lat=p["lat"])
    return q["easting"], q["northing"]


def interpolated(values: np.ndarray, fx: np.ndarray, fy: np.ndarray, shape: tuple[int, int], first: tuple[int, int], method: str) -> np.ndarray:
    """Values of a window (``first`` row and column of a raster of ``shape``) at fractional columns and rows of the raster; NaN outside and next to gaps."""
    rows, cols = shape
    out = np.full(fx.shape, np.nan)
    at = (fx >= -0.5) & (fx <= cols - 0.5) & (fy >= -0.5) & (fy <= rows - 0.5)
    if not at.any() or not values.size:
        return out
    x, y = np.clip(fx[at], 0, cols - 1), np.clip(fy[at], 0, rows - 1)
    pick = lambda r, c: values[r - first[0], c - first[1]]
    if method == "nearest":
        out[at] = pick(np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int))
        return out
    c, r = np.floor(x).astype(int), np.floor(y).astype(int)
    u, v = x - c, y - r
    total = np.zeros(len(x))
    for dr, dc, w in ((0, 0, (1 - u) * (1 - v)), (0, 1, u * (1 - v)), (1, 0, (1 - u) * v), (1, 1, u * v)):
        used = w > 0  # a neighbour without weight may be missing
        total[used] += w[used] * pick(r[used] + dr, c[used] + dc)
    out[at] = total
    return out


def _band(data: geotiff.Ranged, task: dict, cell: float, level: int | None, method: str, change) -> np.ndarray:
    """Values of a raster at one band of an area's pixels, n_rows x n_cols with the margin."""
    m = task["margin"]
    col, row = np.arange(-m, task["n_cols"] + m), np.arange(task["first_row"], task["last_row"])
    x, y = np.meshgrid(task["xmin"] + col * cell, task["ymax"] - row * cell)
    head = geotiff.parse(data, level)
    x, y = _projected(x, y, task["utm_zone"], task["south"], head.epsg)
    x0, y0, sx, sy = head.transform
    window = (x.min() - 2 * sx, y.min() - 2 * sy, x.max() + 2 * sx, y.max() + 2 * sy)
    head, r0, c0, values = geotiff.array(data, window, level)
    return interpolated(change(values), (x - x0) / sx - 0.5, (y0 - y) / sy - 0.5, head.shape[1:], (r0, c0), method)


def decibels(linear: np.ndarray, limit: float = NODATA_DB) -> np.ndarray:
    """As ``radiometry.calibrated``: NaN where power is not positive or decibels reach the limit."""
    with np.errstate(invalid="ignore", divide="ignore"):
        out = 10.0 * np.log10(np.where(linear > 0, linear, np.nan))
        return np.where(out < limit, out, np.nan)


def on_grid(work: DataFrame, names: tuple[str, ...], keep: tuple[str, ...], cell: float, level: int | None, method: str, change, sign: Callable[[str], str] | None = None, attempts: int = 5, wait: float = 20.0) -> DataFrame:
    """Columns ``keep``, aoi_id, px_row, px_col and a value for each name, from rows of work: those of ``grids``, first_row, last_row
    (of the band, that one out), and the place of a raster under each name. Each attempt at a raster signs its link anew."""
    schema = ", ".join([*(f"{k} {dict(work.dtypes)[k]}" for k in keep), "aoi_id int, px_row int, px_col int", *(f"{n} double" for n in names)])
    fields = [*keep, "aoi_id", "px_row", "px_col", *names]

    def kernel(batches):
        def values(href: str, task: dict) -> np.ndarray:
            return base.with_retry(lambda link: _band(geotiff.opened(link), task, cell, level, method, change), (lambda: sign(href)) if sign else href, attempts, wait)

        for batch in batches:
            for k, task in enumerate(batch.to_pylist()):
                got = [values(task[n], task) for n in names]
                row, col = np.indices(got[0].shape, np.int32)
                n, m = row.size, task["margin"]
                same = [batch.column(c).take(pa.array([k] * n, pa.int32())) for c in keep]
                columns = [*same, pa.array(np.full(n, task["aoi_id"], np.int32)), pa.array(row.ravel() + np.int32(task["first_row"])), pa.array(col.ravel() - np.int32(m)), *(pa.array(v.ravel(), mask=np.isnan(v.ravel())) for v in got)]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return work.mapInArrow(kernel, schema)


def in_bands(work: DataFrame, rows: int = BAND_ROWS) -> DataFrame:
    """A row for each band of pixel rows, dealt over the tasks."""
    first = F.expr(f"explode(sequence(-margin, n_rows + margin - 1, {rows}))")
    out = work.withColumn("first_row", first).withColumn("last_row", F.least(F.col("first_row") + rows, F.col("n_rows") + F.col("margin")))
    return out.repartition(F.col("aoi_id"), F.col("first_row"), F.xxhash64(*[c for c in work.columns if dict(work.dtypes)[c] == "string"]))


class SceneReader:
    """What a ``FloodRun`` reads with: scenes of a source as observations, terrain as elevations, on areas' pixel grids."""

    def __init__(self, spark: SparkSession, source: SceneSource, cell: float = CELL_SIZE, level: int | None = SCENE_LEVEL, dem_level: int | None = DEM_LEVEL, method: str = "bilinear", attempts: int = 5, wait: float = 20.0) -> None:
        self.spark, self.source, self.cell, self.level, self.dem_level, self.method = spark, source, cell, level, dem_level, method
        self.retry = {"attempts": attempts, "wait": wait}

    def __call__(self, scenes: DataFrame, areas: DataFrame) -> DataFrame:
        """aoi_id, scene_id, obs_date, px_row, px_col, vv, vh (decibels). Of a scene's rasters (bursts) the last that has a value counts."""
        rasters = self.source.rasters(scenes)
        pairs = catalog.match(areas, scenes)
        work = in_bands(pairs.join(rasters, "scene_id").join(grids(areas, self.cell), "aoi_id"))
        keep = ("scene_id", "obs_date", "part")
        got = on_grid(work, ("vv", "vh"), keep, self.cell, self.level, self.method, decibels, self.source.signing(), **self.retry)
        if not self.source.several:
            return got.drop("part")
        key = ["aoi_id", "scene_id", "obs_date", "px_row", "px_col"]
        last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("part"))).alias(c)
        return got.groupBy(*key).agg(last("vv"), last("vh"))

    def terrain(self, areas: DataFrame, buffer: float, last: bool = True) -> DataFrame:
        """aoi_id, px_row, px_col, elev with the buffer's margin around each area; 0 where no item has a value. Of several the last counts, or the first."""
        box = catalog.union_box(areas).first()
        items = self.source.search_dem((box["minx"], box["miny"], box["maxx"], box["maxy"]))
        items = items.select(F.col("scene_id").alias("item"), self.source.dem_href().alias("elev"), *catalog.BOX)
        near = F.lit(buffer / 100_000.0)  # degrees, more than enough outside the polar regions
        wide = areas.select("aoi_id", F.col("minx") - near * 2, F.col("miny") - near, F.col("maxx") + near * 2, F.col("maxy") + near).toDF("aoi_id", *catalog.BOX)
        pairs = catalog.match(wide, items.withColumnRenamed("item", "scene_id")).withColumnRenamed("scene_id", "item")
        work = in_bands(pairs.join(items.select("item", "elev"), "item").join(grids(areas, self.cell, buffer), "aoi_id"))
        got = on_grid(work, ("elev",), ("item",), self.cell, self.dem_level, "bilinear", lambda v: v, self.source.signing(), **self.retry)
        pick = F.max_by if last else F.min_by
        return got.groupBy("aoi_id", "px_row", "px_col").agg(F.coalesce(pick("elev", F.when(F.col("elev").isNotNull(), F.col("item"))), F.lit(0.0)).alias("elev"))


for _name in (__name__, base.__name__, geotiff.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])
