"""Zones, projections and polygon predicates, all as JVM expressions.

A projection is a list of steps, each a few named SQL expressions over the columns of the step before. ``apply``
adds them to a DataFrame; ``nested`` writes them as subqueries in plain SQL, which other engines also read.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import LATITUDE_BANDS, SQUARE_COLUMNS, SQUARE_ROWS

Steps = list[dict[str, str]]

# WGS 84 and the transverse Mercator series in the third flattening, to its fourth power.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
MOLLWEIDE_ROUNDS = 12


def num(x: float) -> str:
    """A double in SQL."""
    return f"{x:.17e}"


def _series(terms: Sequence[float], a: str, b: str, fa: str, fb: str) -> str:
    return " + ".join(f"{num(t)} * {fa}({2 * j} * {a}) * {fb}({2 * j} * {b})" for j, t in enumerate(terms, 1))


def utm_forward(lon: str, lat: str, zone: str, south: str, east: str = "easting", north: str = "northing") -> Steps:
    """Degrees to metres in UTM ``zone`` (number), ``south`` a condition."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    return [
        {"_dl": f"radians({lon} - (6 * {zone} - 183))", "_t": f"sinh(atanh(sin(radians({lat}))) - {num(e)} * atanh({num(e)} * sin(radians({lat}))))"},
        {"_xi": "atan2(_t, cos(_dl))", "_eta": "asinh(sin(_dl) / sqrt(_t * _t + cos(_dl) * cos(_dl)))"},
        {
            east: f"{num(FALSE_EASTING)} + {num(SCALE * _RADIUS)} * (_eta + {_series(FORWARD, '_xi', '_eta', 'cos', 'sinh')})",
            north: f"(CASE WHEN {south} THEN {num(FALSE_NORTHING)} ELSE {num(0)} END) + {num(SCALE * _RADIUS)} * (_xi + {_series(FORWARD, '_xi', '_eta', 'sin', 'cosh')})",
        },
    ]


def utm_inverse(east: str, north: str, zone: str, south: str, lon: str = "lon", lat: str = "lat") -> Steps:
    """Metres in UTM ``zone`` to degrees."""
    return [
        {
            "_x": f"({north} - (CASE WHEN {south} THEN {num(FALSE_NORTHING)} ELSE {num(0)} END)) / {num(SCALE * _RADIUS)}",
            "_e": f"({east} - {num(FALSE_EASTING)}) / {num(SCALE * _RADIUS)}",
        },
        {"_xi": f"_x - ({_series(INVERSE, '_x', '_e', 'sin', 'cosh')})", "_eta": f"_e - ({_series(INVERSE, '_x', '_e', 'cos', 'sinh')})"},
        {"_chi": "asin(sin(_xi) / cosh(_eta))"},
        {
            lat: "degrees(_chi + " + " + ".join(f"{num(t)} * sin({2 * j} * _chi)" for j, t in enumerate(LATITUDE, 1)) + ")",
            lon: f"(6 * {zone} - 183) + degrees(atan2(sinh(_eta), cos(_xi)))",
        },
    ]


def mollweide_forward(lon: str, lat: str, x: str = "mx", y: str = "my") -> Steps:
    """Degrees to the equal-area world projection, on a sphere of the semi-major axis."""
    start = {"_m": f"radians({lat})", "_th": f"radians({lat})"}
    newton = {"_th": f"_th - (_th + sin(_th) - {num(math.pi)} * sin(_m)) / greatest(1 + cos(_th), {num(1e-12)})"}
    end = {x: f"{num(2 * math.sqrt(2) / math.pi * SEMI_MAJOR)} * radians({lon}) * cos(_th / 2)", y: f"{num(math.sqrt(2) * SEMI_MAJOR)} * sin(_th / 2)"}
    return [start, *[newton] * MOLLWEIDE_ROUNDS, end]


def mollweide_inverse(x: str, y: str, lon: str = "lon", lat: str = "lat") -> Steps:
    return [
        {"_th": f"asin({y} / {num(math.sqrt(2) * SEMI_MAJOR)})"},
        {lat: f"degrees(asin((2 * _th + sin(2 * _th)) / {num(math.pi)}))", lon: f"degrees({x} / ({num(2 * math.sqrt(2) / math.pi * SEMI_MAJOR)} * cos(_th)))"},
    ]


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    own = {k for step in steps for k in step if k.startswith("_")}
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.drop(*own)


def evaluate(steps: Steps, zone: int, south: bool, **arrays: np.ndarray) -> dict[str, np.ndarray]:
    """Steps over NumPy arrays, for kernels at file boundaries; ``zone`` and ``south`` are those of all points."""
    names = {"sin": np.sin, "cos": np.cos, "sinh": np.sinh, "cosh": np.cosh, "asin": np.arcsin, "asinh": np.arcsinh, "atanh": np.arctanh, "atan2": np.arctan2, "sqrt": np.sqrt, "radians": np.radians, "degrees": np.degrees, "zone": zone}
    known = names | arrays
    for step in steps:
        plain = {k: re.sub(r"CASE WHEN south THEN (.*?) ELSE (.*?) END", r"\1" if south else r"\2", v) for k, v in step.items()}
        known |= {k: eval(v, {"__builtins__": {}}, known) for k, v in plain.items()}  # noqa: S307  the steps of this module
    return known


def nested(source: str, steps: Steps) -> str:
    """The steps as SQL subqueries over a table or a query in parentheses."""
    made: set[str] = set()
    for step in steps:
        seen = [k for k in step if k in made]
        made |= set(step)
        drop = f" EXCLUDE ({', '.join(seen)})" if seen else ""
        source = f"(SELECT *{drop}, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {source})"
    return source


def utm_zone(lon: Column) -> Column:
    """1 to 60, without the exceptions around Norway."""
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def latitude_band(lat: Column) -> Column:
    """Band letter from 80 S to 84 N; other latitudes are an error."""
    at = F.least(F.floor((lat + 80.0) / 8.0), F.lit(len(LATITUDE_BANDS) - 1)).cast("int")
    letter = F.substr(F.lit(LATITUDE_BANDS), at + 1, F.lit(1))
    bad = F.raise_error(F.concat(F.lit("latitude outside 80 S to 84 N: "), lat.cast("string")))
    return F.when(lat.isNull() | lat.between(-80.0, 84.0), letter).otherwise(bad)


def zone_name(lon: Column, lat: Column) -> Column:
    return F.concat(utm_zone(lon).cast("string"), latitude_band(lat))


def zone_to_epsg(zone: Column) -> Column:
    """EPSG code (integer) of a zone such as 45R or 7n; bands N to X are northern, C to M southern."""
    number, band = F.regexp_extract(zone, "^([0-9]{1,2})[A-Za-z]$", 1), F.upper(F.regexp_extract(zone, "^[0-9]{1,2}([A-Za-z])$", 1))
    base = F.when(band.rlike("^[NP-X]$"), 32600).when(band.rlike("^[C-HJ-M]$"), 32700)
    code = base + F.nullif(number, F.lit("")).cast("int")
    return F.when(zone.isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("no such zone: "), zone)))


def square_name(zone: Column, band: Column, easting: Column, northing: Column) -> Column:
    """Name of the 100 km square: zone number, band, column and row letter."""
    letters = F.element_at(F.array(*map(F.lit, SQUARE_COLUMNS)), (zone % 3 + 1).cast("int"))
    rows = F.element_at(F.array(*map(F.lit, SQUARE_ROWS)), (zone % 2 + 1).cast("int"))
    column = F.substr(letters, F.floor(easting / 100000.0).cast("int"), F.lit(1))
    row = F.substr(rows, (F.floor(northing / 100000.0) % 20 + 1).cast("int"), F.lit(1))
    return F.concat(zone.cast("string"), band, column, row)


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed ring of five points."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(minx, miny), p(maxx, miny), p(maxx, maxy), p(minx, maxy), p(minx, miny))


def ring_literal(points: Sequence[tuple[float, float]]) -> Column:
    closed = [*points] if points[0] == points[-1] else [*points, points[0]]
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in closed])


def ring_of_pairs(pairs: Column) -> Column:
    """A ring from arrays of two numbers, as GeoJSON has them."""
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def edges(ring: Column) -> Column:
    """Segments (ax, ay, bx, by) of a closed ring."""
    ends = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    return F.transform(ends, lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: a point on the lower or left edge of a box is inside, on the upper or right one not."""

    def crossed(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def segment_meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a segment and a closed box share a point: neither axis nor the segment's normal separates them."""
    apart = (F.greatest(e["ax"], e["bx"]) < minx) | (F.least(e["ax"], e["bx"]) > maxx) | (F.greatest(e["ay"], e["by"]) < miny) | (F.least(e["ay"], e["by"]) > maxy)
    side = lambda x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    corners = [side(x, y) for x in (minx, maxx) for y in (miny, maxy)]
    return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def ring_meets_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.exists(edges(ring), lambda e: segment_meets_box(e, minx, miny, maxx, maxy)) | inside(minx, miny, ring)


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two closed boxes (structs of minx, miny, maxx, maxy) share a point."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: edges cross or touch, or one holds the other."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))

    def meet(e: Column, f: Column) -> Column:
        near = (F.least(e["ax"], e["bx"]) <= F.greatest(f["ax"], f["bx"])) & (F.greatest(e["ax"], e["bx"]) >= F.least(f["ax"], f["bx"]))
        near &= (F.least(e["ay"], e["by"]) <= F.greatest(f["ay"], f["by"])) & (F.greatest(e["ay"], e["by"]) >= F.least(f["ay"], f["by"]))
        return near & (side(e, f["ax"], f["ay"]) * side(e, f["bx"], f["by"]) <= 0) & (side(f, e["ax"], e["ay"]) * side(f, e["bx"], e["by"]) <= 0)

    cross = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: meet(e, f)))
    first = lambda r, k: F.element_at(r, 1)[k]
    return cross | inside(first(a, "x"), first(a, "y"), b) | inside(first(b, "x"), first(b, "y"), a)


# Kernels at file boundaries project too, and workers may not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
