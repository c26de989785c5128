"""Rasters onto a fixed pixel grid, as joins.

A target grid is a row per tile (corner, cell size, zone); its pixels are made by two sequences. Each pixel's centre is
projected back to a fractional index of the source lattice. Four (index, weight) rows per pixel make a weights
table, which does not depend on a scene: it is made once per tile and lattice, and every scene is an equi-join
with it and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CELL_SIZE
from tidemark.functions import geo


def lattice(tiles: DataFrame, cell: float = CELL_SIZE) -> DataFrame:
    """A row per pixel of tiles (aoi_id, utm_zone, south, xmin, ymin, xmax, ymax in metres): px_row, px_col, x, y of its position.

    Columns go right from xmin, rows down from ymax, as long as they stay inside."""
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / float(cell)).cast("int")
    t = tiles.withColumns({"_cols": n("xmin", "xmax"), "_rows": n("ymin", "ymax")}).filter("_cols > 0 and _rows > 0")
    t = t.withColumn("px_row", F.explode(F.expr("sequence(0, _rows - 1)"))).withColumn("px_col", F.explode(F.expr("sequence(0, _cols - 1)")))
    t = t.withColumns({"x": F.col("xmin") + F.col("px_col") * float(cell), "y": F.col("ymax") - F.col("px_row") * float(cell)})
    return t.drop("_cols", "_rows")


def tile_bounds(tiles: DataFrame, buffer: float = 0.0) -> DataFrame:
    """xmin..ymax in metres of tiles (aoi_id, utm_zone, south, ring in degrees), widened by ``buffer`` metres."""
    p = tiles.select("*", F.explode("ring").alias("_p")).withColumns({"_lon": F.col("_p.x"), "_lat": F.col("_p.y")})
    p = p.withColumns({"_vlon": F.col("_lon"), "_vlat": F.col("_lat")})
    m = geo.apply(p.withColumnsRenamed({"_vlon": "vlon", "_vlat": "vlat"}), geo.utm_forward("vlon", "vlat", "utm_zone", "south"))
    own = ["aoi_id", "utm_zone", "south"]
    ends = m.groupBy(*own).agg(*[(f(c) + F.lit(float(d) * buffer)).alias(k) for k, f, c, d in (("xmin", F.min, "easting", -1), ("ymin", F.min, "northing", -1), ("xmax", F.max, "easting", 1), ("ymax", F.max, "northing", 1))])
    return ends


def weights(pixels: DataFrame, fx: Column, fy: Column, n_cols: int, n_rows: int, method: str = "bilinear") -> DataFrame:
    """aoi_id, px_row, px_col, src_row, src_col, weight for pixels with fractional source indexes fx, fy.

    Indexes beyond the source's edge are those of the edge. ``nearest`` gives one row of weight 1 per pixel."""
    clamp = lambda i, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int")
    base = pixels.select("aoi_id", "px_row", "px_col", fx.alias("_fx"), fy.alias("_fy"))
    if method == "nearest":
        pick = lambda c, n: clamp(F.floor(F.col(c) + 0.5), n)
        return base.select("aoi_id", "px_row", "px_col", pick("_fy", n_rows).alias("src_row"), pick("_fx", n_cols).alias("src_col"), F.lit(1.0).alias("weight"))
    if method != "bilinear":
        raise ValueError(f"method must be bilinear or nearest, not {method!r}")
    base = base.withColumns({"_x": F.greatest(F.lit(0.0), F.least(F.lit(n_cols - 1.0), "_fx")), "_y": F.greatest(F.lit(0.0), F.least(F.lit(n_rows - 1.0), "_fy"))})
    base = base.withColumns({"_x0": F.floor("_x").cast("int"), "_y0": F.floor("_y").cast("int")})
    part = lambda v, v0, up: (F.col(v) - F.col(v0)) if up else (F.lit(1.0) + F.col(v0) - F.col(v))
    four = F.array(*[F.struct(clamp(F.col("_y0") + dy, n_rows).alias("r"), clamp(F.col("_x0") + dx, n_cols).alias("c"), (part("_y", "_y0", dy) * part("_x", "_x0", dx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    return base.select("aoi_id", "px_row", "px_col", F.explode(F.filter(four, lambda q: q["w"] > 0)).alias("q")).select("aoi_id", "px_row", "px_col", F.col("q.r").alias("src_row"), F.col("q.c").alias("src_col"), F.col("q.w").alias("weight"))


def regrid(source: DataFrame, table: DataFrame, columns=("vv", "vh"), keys=("scene_id",), lattice=("src_row", "src_col")) -> DataFrame:
    """``source`` (keys, columns, and ``lattice``, which names its cells) on the pixels of a weights table; a missing source cell is a gap."""
    keys = list(keys)
    j = source.join(table, list(lattice))
    total = F.sum("weight")
    # All weight of a pixel must be of valid cells; weights of a pixel sum to 1.
    value = lambda c: F.when(F.round(F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))), 9) == 1.0, F.sum(F.col(c) * F.col("weight")) / total).alias(c)
    return j.groupBy(*keys, "aoi_id", "px_row", "px_col").agg(*[value(c) for c in columns])


def mosaic(parts: DataFrame, key: list[str], value: str, order: str, last: bool = True) -> DataFrame:
    """One value per cell: of the part of largest (or smallest) ``order`` that has one there."""
    pick = F.max_by if last else F.min_by
    return parts.filter(F.col(value).isNotNull()).groupBy(*key).agg(pick(value, order).alias(value))


def world_cells(pixels: DataFrame, cell: float, keys: list[str], value: str, order: str = "aoi_id", how: str = "last") -> DataFrame:
    """Pixels with lon, lat on a common equal-area grid: world_row, world_col, ``value``.

    ``how``: last or first tile wins, or mean. A world cell takes what pixels have their position in it."""
    p = geo.apply(pixels, geo.mollweide_forward("lon", "lat"))
    at = lambda c, s: F.floor(F.col(c) * s / float(cell)).cast("long")
    p = p.withColumns({"world_col": at("mx", 1.0), "world_row": at("my", -1.0)})
    if how == "mean":
        return p.groupBy(*keys, "world_row", "world_col").agg(F.avg(value).alias(value))
    return mosaic(p.withColumn("_ord", F.struct(F.col(order), F.col(value))), [*keys, "world_row", "world_col"], value, "_ord", how == "last")
