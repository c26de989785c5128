"""Neighbourhoods on the pixel grid: slope, majority, coarser grids.

Both filters separate into a pass along rows and one along columns, with range frames, so a missing pixel is a
missing neighbour and nothing is multiplied by the area of the neighbourhood. A window holds one row or column of
one raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import CELL_SIZE


def _along(keys: list[str], line: str, across: str):
    return Window.partitionBy(*keys, line).orderBy(across)


def slope(dem: DataFrame, cell: float = CELL_SIZE, fill: float | None = 0.0, keys=("aoi_id",)) -> DataFrame:
    """Degrees of slope by Horn's weights from the eight neighbours of ``elev``.

    Where one of them is missing, as at the border, the slope is ``fill`` (None: NULL)."""
    keys = list(keys)
    row, col = _along(keys, "px_row", "px_col"), _along(keys, "px_col", "px_row")
    at = lambda c, w, d: F.sum(c).over(w.rangeBetween(d, d))
    d = dem.withColumns({"_w": at("elev", row, -1), "_e": at("elev", row, 1)})
    d = d.withColumns({"_dx": F.col("_e") - F.col("_w"), "_sum": F.col("_w") + F.col("elev") * 2.0 + F.col("_e")})
    d = d.withColumns({f"_{n}{c}": at(f"_{c}", col, k) for n, k in (("up", -1), ("down", 1)) for c in ("dx", "sum")})
    dx = (F.col("_updx") + F.col("_dx") * 2.0 + F.col("_downdx")) / (8.0 * cell)
    dy = (F.col("_downsum") - F.col("_upsum")) / (8.0 * cell)
    steep = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    return d.select(*keys, "px_row", "px_col", (steep if fill is None else F.coalesce(steep, F.lit(fill))).alias("slope_deg"))


def majority(classified: DataFrame, size: int = 3, keys=("aoi_id", "scene_id")) -> DataFrame:
    """The commonest class of the ``size`` x ``size`` neighbourhood, the lowest of equals.

    Gaps do not vote but are filled where a neighbour is valid. ``classified`` has one row per key and pixel; pixels
    may be missing. Votes are first summed along rows, at missing pixels too, before they are shuffled; then along columns."""
    if size < 1 or size % 2 == 0:
        raise ValueError(f"size must be a positive odd number, not {size!r}")
    keys, half = list(keys), size // 2
    rest = [c for c in classified.columns if c not in (*keys, "px_row", "px_col", "cls")]
    spread = classified.select(*keys, "px_row", F.col("px_col").alias("_at"), *rest, "cls", F.explode(F.sequence(F.col("px_col") - half, F.col("px_col") + half)).alias("px_col"))
    own = F.when(F.col("_at") == F.col("px_col"), F.struct(F.lit(True).alias("there"), *rest))
    votes = spread.groupBy(*keys, "px_row", "px_col").agg(*[F.count_if(F.col("cls") == c).alias(f"_v{c}") for c in range(4)], F.max(own).alias("_own"))
    column = _along(keys, "px_col", "px_row").rangeBetween(-half, half)
    d = votes.withColumns({f"_v{c}": F.sum(f"_v{c}").over(column) for c in range(4)}).filter("_own is not null")
    most = F.greatest(*[F.col(f"_v{c}") for c in range(4)])
    smooth = F.when(most > 0, F.coalesce(*[F.when(F.col(f"_v{c}") == most, F.lit(c)) for c in range(4)]))
    made = {"cls": smooth} | {c: F.col(f"_own.{c}") for c in rest}
    return d.select(*[made.get(c, F.col(c)).alias(c) for c in classified.columns])


def block_mean(obs: DataFrame, factor: int, columns: list[str], keys: list[str]) -> DataFrame:
    """Means of ``factor`` x ``factor`` blocks, gaps skipped."""
    return obs.groupBy(*keys, _block("px_row", factor), _block("px_col", factor)).agg(*[F.avg(c).alias(c) for c in columns])


def thinned(obs: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel of every ``factor``-th row."""
    kept = obs.filter((F.col("px_row") % factor == 0) & (F.col("px_col") % factor == 0))
    return kept.withColumns({c: F.expr(f"cast({c} div {int(factor)} as int)") for c in ("px_row", "px_col")})


def _block(column: str, factor: int) -> Column:
    return F.expr(f"cast({column} div {int(factor)} as int)").alias(column)


def thinning_factor(longer_side: int, most: int) -> int:
    """Least whole factor that brings the longer side to ``most`` pixels."""
    return max(1, -(-longer_side // most))
