"""Tile grids over an area of interest.

An area is one ring of degrees, a parameter and not data, so its corners are projected on the driver; tiles
are made and tested on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import DRY_MONTH_PLACEHOLDER
from tidemark.functions import geo

Ring = list[tuple[float, float]]


def clip_ring(ring: Ring, minx: float, miny: float, maxx: float, maxy: float) -> Ring:
    """The part of a ring inside a box, cut side by side."""
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, limit, sign in ((0, minx, 1), (0, maxx, -1), (1, miny, 1), (1, maxy, -1)):
        cut: Ring = []
        for a, b in zip(points, points[1:] + points[:1]):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                cut.append(a)
            if da * db < 0:
                t = da / (da - db)
                p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                p[axis] = limit
                cut.append((p[0], p[1]))
        points = cut
    return points


def utm(lon: float, lat: float, zone: int, south: bool) -> tuple[float, float]:
    """One point in metres; as ``geo.utm_forward``."""
    e, dl, phi = 2 * math.sqrt(geo._N) / (1 + geo._N), math.radians(lon - (6 * zone - 183)), math.radians(lat)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(dl)), math.asinh(math.sin(dl) / math.hypot(t, math.cos(dl)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(geo.FORWARD, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(geo.FORWARD, 1))
    k = geo.SCALE * geo._RADIUS
    return geo.FALSE_EASTING + k * x, (geo.FALSE_NORTHING if south else 0.0) + k * y


def as_ring(area) -> Ring:
    """A ring from a ring, a box (minx, miny, maxx, maxy) or a GeoJSON polygon."""
    if isinstance(area, dict) and area.get("type") == "Polygon":
        return [(float(p[0]), float(p[1])) for p in area["coordinates"][0]]
    if isinstance(area, (list, tuple)) and len(area) == 4 and all(isinstance(v, (int, float)) for v in area):
        a, b, c, d = map(float, area)
        return [(a, b), (c, b), (c, d), (a, d)]
    if isinstance(area, (list, tuple)) and len(area) >= 3 and all(len(p) == 2 for p in area):
        return [(float(x), float(y)) for x, y in area]
    raise TypeError(f"an area is a ring, a box or a GeoJSON polygon, not {type(area)!r}")


def generate(spark: SparkSession, area, mode: str = "mgrs", tile_km: float | None = None) -> DataFrame:
    """aoi_id, zone, epsg, utm_zone, south, xmin, ymin, xmax, ymax, ring, dry_month (a placeholder), mgrs_tile (mode mgrs).

    Squares aligned to multiples of their side in each UTM zone and hemisphere that the area touches. Ids follow
    zone, northern before southern, x, y."""
    if mode not in ("mgrs", "utm_fishnet"):
        raise ValueError(f"mode must be mgrs or utm_fishnet, not {mode!r}")
    if mode == "mgrs" and tile_km is not None:
        raise ValueError("tiles of mode mgrs are always 100 km; leave tile_km out")
    side = 100_000.0 if mode == "mgrs" or tile_km is None else tile_km * 1000.0
    ring = as_ring(area)
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    zone_of = lambda lon: int((lon + 180) // 6) + 1
    nets = []
    for zone in range(zone_of(min(lons)), min(zone_of(max(lons)), 60) + 1):
        for south in (False, True):
            west = 6 * zone - 186
            part = clip_ring(ring, west, -80.0 if south else 0.0, west + 6, 0.0 if south else 84.0)
            if len(part) < 3 or south and min(lats) >= 0 or not south and max(lats) < 0:
                continue
            metres = [utm(x, y, zone, south) for x, y in part]
            xs, ys = [p[0] for p in metres], [p[1] for p in metres]
            lo, hi = (lambda v: math.floor(min(v) / side)), (lambda v: max(math.ceil(max(v) / side), math.floor(min(v) / side) + 1) - 1)
            net = spark.range(1).select(F.lit(zone).alias("utm_zone"), F.lit(south).alias("south"), F.explode(F.sequence(F.lit(lo(xs)), F.lit(hi(xs)))).alias("_i"), F.lit(lo(ys)).alias("_lo"), F.lit(hi(ys)).alias("_hi"))
            net = net.select("utm_zone", "south", "_i", F.explode(F.sequence("_lo", "_hi")).alias("_j"))
            net = net.select("utm_zone", "south", *[(F.col(c) * side + d).alias(k) for k, c, d in (("xmin", "_i", 0.0), ("ymin", "_j", 0.0), ("xmax", "_i", side), ("ymax", "_j", side))])
            nets.append(net.filter(geo.ring_meets_box(geo.ring_literal(metres), *map(F.col, ("xmin", "ymin", "xmax", "ymax")))))
    tiles = None
    for net in nets:
        tiles = net if tiles is None else tiles.unionByName(net)
    if tiles is None or tiles.isEmpty():
        raise ValueError("no tile meets the area; it is empty or invalid")
    return _named(tiles, mode)


def _named(tiles: DataFrame, mode: str) -> DataFrame:
    corner = lambda k, x, y: geo.utm_inverse(x, y, "utm_zone", "south", f"lon{k}", f"lat{k}")
    t = tiles.withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})
    for k, x, y in ((0, "xmin", "ymin"), (1, "xmax", "ymin"), (2, "xmax", "ymax"), (3, "xmin", "ymax"), ("c", "cx", "cy")):
        t = geo.apply(t, corner(k, x, y))
    p = lambda k: F.struct(F.col(f"lon{k}").alias("x"), F.col(f"lat{k}").alias("y"))
    band = geo.latitude_band(F.col("latc"))
    order = Window.orderBy("utm_zone", "south", "xmin", "ymin")  # a row per tile of the area
    t = t.withColumns({"aoi_id": F.row_number().over(order), "zone": F.concat(F.col("utm_zone").cast("string"), band), "ring": F.array(p(0), p(1), p(2), p(3), p(0))})
    t = t.withColumn("epsg", F.when(F.col("south"), 32700).otherwise(32600) + F.col("utm_zone")).withColumn("dry_month", F.lit(DRY_MONTH_PLACEHOLDER))
    out = ["aoi_id", "zone", "epsg", "utm_zone", "south", "xmin", "ymin", "xmax", "ymax", "ring", "dry_month"]
    if mode == "mgrs":
        t, out = t.withColumn("mgrs_tile", geo.square_name(F.col("utm_zone"), band, F.col("cx"), F.col("cy"))), [*out, "mgrs_tile"]
    return t.select(*out)
