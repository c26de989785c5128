"""GeoPackage files (SQLite with polygons in WKB) as tables, and tables as such files.

Spark reads and workers parse whole files, which hold areas or outlines and are small beside rasters; databases live in memory, so nothing is
written to a local disk. Of a polygon the outer ring counts, of several polygons each is a row.
"""

from __future__ import annotations

import sqlite3
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo

#: Bytes of the bounding box in a geometry's header, by its kind.
_ENVELOPES = (0, 32, 48, 48, 64)
RING = "array<struct<x: double, y: double>>"


def rings(blob: bytes) -> list[list[tuple[float, float]]]:
    """Outer rings of a geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return _rings(blob, 8 + _ENVELOPES[blob[3] >> 1 & 7])[0]


def _rings(wkb: bytes, at: int) -> tuple[list[list[tuple[float, float]]], int]:
    order = "<" if wkb[at] else ">"
    kind, n = struct.unpack(order + "II", wkb[at + 1 : at + 9])
    size = 2 + (kind & 0x80000000 > 0) + (kind & 0x40000000 > 0) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
    plain, at, out = (kind & 0xFFFF) % 1000, at + 9, []
    if plain == 6:
        for _ in range(n):
            found, at = _rings(wkb, at)
            out += found
    elif plain == 3:
        for k in range(n):
            points = struct.unpack(order + "I", wkb[at : at + 4])[0]
            flat = struct.unpack(f"{order}{points * size}d", wkb[at + 4 : at + 4 + 8 * size * points])
            at += 4 + 8 * size * points
            if k == 0:
                out.append([(flat[i], flat[i + 1]) for i in range(0, len(flat), size)])
    else:
        raise ValueError(f"geometry of kind {plain} is no polygon")
    return out, at


def features(data: bytes, layer: str | None = None) -> list[tuple[dict, list[list[tuple[float, float]]]]]:
    """Properties and outer rings of each feature of a layer, the first if none is named."""
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        layers = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall())
        name = layer or next(iter(layers), None)
        if name not in layers:
            raise ValueError(f"no layer {name!r}; there are {', '.join(layers) or 'none'}")
        quoted = name.replace('"', '""')
        cursor = db.execute(f'SELECT * FROM "{quoted}"')
        columns = [c[0] for c in cursor.description]
        rows = [dict(zip(columns, r)) for r in cursor]
    return [({k: v for k, v in r.items() if k != layers[name]}, rings(r[layers[name]])) for r in rows if r[layers[name]] is not None]


def read(spark: SparkSession, path: str, layer: str | None = None, id_col: str = "ID", zone_col: str = "zone", dry_col: str = "dry_month") -> DataFrame:
    """Tiles: aoi_id, zone, dry_month, ring, minx..maxy. The id column may have any name."""

    def kernel(parts):
        for part in parts:
            found = [(p, r) for data in part["content"] for p, rings_ in features(data, layer) for r in rings_]
            text = lambda p, c: None if p.get(c) is None else str(p[c])
            yield pd.DataFrame({"aoi_id": [text(p, id_col) for p, _ in found], "zone": [text(p, zone_col) for p, _ in found], "dry_month": [text(p, dry_col) for p, _ in found], "ring": [[{"x": x, "y": y} for x, y in r] for _, r in found]})

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInPandas(kernel, f"aoi_id string, zone string, dry_month string, ring {RING}").withColumn("aoi_id", F.col("aoi_id").cast("int"))
    return out.withColumn("_b", geo.ring_bounds(F.col("ring"))).select("*", "_b.*").drop("_b")


def geometry(ring: list[tuple[float, float]], srs: int) -> bytes:
    """One polygon with its bounding box."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    head = b"GP\0\3" + struct.pack("<i4d", srs, min(xs), max(xs), min(ys), max(ys))
    return head + struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)


def encode(rows: list[tuple[dict, list[tuple[float, float]]]], layer: str = "features", srs: int = 4326) -> bytes:
    """A file with one layer of polygons. Properties are those of the first row; whole numbers, numbers and text keep their kind."""
    names = list(rows[0][0]) if rows else []
    kinds = [next((v for p, _ in rows if (v := p[n]) is not None), "") for n in names]
    kinds = ["INTEGER" if isinstance(v, int) else "REAL" if isinstance(v, float) else "TEXT" for v in kinds]
    quoted = [f'"{n.replace(chr(34), chr(34) * 2)}"' for n in (layer, *names)]
    with sqlite3.connect(":memory:") as db:
        db.executescript(f"""
PRAGMA application_id = {0x47504B47};
PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
CREATE TABLE {quoted[0]} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom POLYGON{''.join(f', {q} {k}' for q, k in zip(quoted[1:], kinds))});
""")
        for code, name in ((-1, "Undefined Cartesian"), (0, "Undefined geographic"), (srs, f"EPSG:{srs}")):
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (name, code, "EPSG" if code > 0 else "NONE", code))
        points = [p for _, ring in rows for p in ring]
        box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else (None,) * 4
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '2000-01-01T00:00:00.000Z', ?, ?, ?, ?, ?)", (layer, layer, *box, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs))
        marks = ", ".join("?" * (len(names) + 1))
        db.executemany(f"INSERT INTO {quoted[0]} (geom{''.join(f', {q}' for q in quoted[1:])}) VALUES ({marks})", [(geometry(ring, srs), *(p[n] for n in names)) for p, ring in rows])
        db.commit()
        return db.serialize()


def files(outlines: DataFrame, key: str, layer: str = "features", srs: int = 4326) -> DataFrame:
    """``key``, content: one file per key with its outlines, ready for ``geotiff.save``. ``outlines``: key, ring, and properties."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v if isinstance(v, (int, float, str)) else str(v)
        rows = [({n: plain(r[n]) for n in part.columns if n != "ring"}, [(p["x"], p["y"]) for p in r["ring"]]) for r in part.to_dict("records")]
        return pd.DataFrame({key: [part[key].iloc[0]], "content": [encode(rows, layer, srs)]})

    return outlines.groupBy(key).applyInPandas(kernel, f"{key} {dict(outlines.dtypes)[key]}, content binary")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
