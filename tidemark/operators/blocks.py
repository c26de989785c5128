"""Rasters as rows of pixels and as rows of blocks, and arrays as either.

Pixels are the form that questions are asked in; blocks (arrays of a square of pixels) are the form for kernels and for
files, with a hundred-thousandth of the rows. Both ways are built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.radiometry import no_nan

SIDE = 256


def to_blocks(pixels: DataFrame, keys: list[str], values: list[str], side: int = SIDE) -> DataFrame:
    """keys, block_row, block_col and an array of side * side floats per value, row by row; missing pixels are NULL in it."""
    at = F.col("px_row") % side * side + F.col("px_col") % side
    p = pixels.withColumns({"block_row": F.expr(f"cast(px_row div {side} as int)"), "block_col": F.expr(f"cast(px_col div {side} as int)"), "_at": at.cast("int")})
    maps = p.groupBy(*keys, "block_row", "block_col").agg(*[F.map_from_entries(F.collect_list(F.struct("_at", F.col(v).cast("float")))).alias(v) for v in values])
    dense = lambda v: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at(v, i))
    return maps.select(*keys, "block_row", "block_col", *[dense(F.col(v)).alias(v) for v in values])


def from_blocks(blocks: DataFrame, keys: list[str], values: list[str], side: int = SIDE) -> DataFrame:
    """keys, px_row, px_col, values; pixels without any value are left out."""
    b = blocks.select(*keys, "block_row", "block_col", F.posexplode(F.arrays_zip(*values)).alias("_at", "_v"))
    row, col = F.col("block_row") * side + F.expr(f"_at div {side}").cast("int"), F.col("block_col") * side + F.col("_at") % side
    out = b.select(*keys, row.alias("px_row"), col.alias("px_col"), *[no_nan(F.col(f"_v.{v}").cast("double")).alias(v) for v in values])
    return out.filter(" or ".join(f"{v} is not null" for v in values))


def from_array(spark: SparkSession, values: np.ndarray, bands: list[str] | None = None) -> DataFrame:
    """px_row, px_col and a column ``value``, or one per band, from an array of rows x columns or bands x rows x columns. NaN is a gap.

    For arrays that the driver holds anyway, as in tests and notebooks."""
    if values.ndim not in (2, 3):
        raise ValueError(f"an array has 2 or 3 dimensions, not {values.ndim}")
    cube = values[None] if values.ndim == 2 else values
    names = bands or (["value"] if values.ndim == 2 else [f"band{k + 1}" for k in range(len(cube))])
    if len(names) != len(cube):
        raise ValueError(f"{len(names)} names for {len(cube)} bands")
    row, col = np.indices(cube.shape[1:])
    frame = pd.DataFrame({"px_row": row.ravel().astype(np.int32), "px_col": col.ravel().astype(np.int32)} | {n: b.ravel().astype(float) for n, b in zip(names, cube)})
    return spark.createDataFrame(frame).withColumns({n: no_nan(F.col(n)) for n in names})


def with_epsg(table: DataFrame, areas: DataFrame) -> DataFrame:
    """Adds the EPSG code of each row's area, from its zone."""
    return table.join(areas.select("aoi_id", geo.zone_to_epsg(F.col("zone")).alias("epsg")), "aoi_id", "left")
