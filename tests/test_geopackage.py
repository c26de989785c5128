"""Areas and outlines through GeoPackage files."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import geopackage, geotiff

RING = [(85.0, 25.0), (85.5, 25.0), (85.5, 25.5), (85.0, 25.0)]


def test_areas_read_back(spark, tmp_path):
    rows = [({"tile id": 318, "zone": "45R", "dry_month": "04,05", "share": 0.5}, RING), ({"tile id": 319, "zone": None, "dry_month": None, "share": None}, [(x + 1, y) for x, y in RING])]
    (tmp_path / "a.gpkg").write_bytes(geopackage.encode(rows, "grid"))
    got = sorted(geopackage.read(spark, str(tmp_path / "a.gpkg"), id_col="tile id").collect())
    assert [(r["aoi_id"], r["zone"], r["dry_month"]) for r in got] == [(318, "45R", "04,05"), (319, None, None)]
    assert [(p["x"], p["y"]) for p in got[0]["ring"]] == RING and (got[1]["minx"], got[1]["maxy"]) == (86.0, 25.5)
    with pytest.raises(ValueError):
        geopackage.features((tmp_path / "a.gpkg").read_bytes(), "other")


def test_what_others_write():
    """Both byte orders, several polygons, holes, heights, and a header without a box."""
    point = lambda o, p: struct.pack(o + "3d", *p, 7.0)
    ring = lambda o, points: struct.pack(o + "I", len(points)) + b"".join(point(o, p) for p in points)
    polygon = lambda o, rings: struct.pack(o + "BII", o == "<", 1003, len(rings)) + b"".join(ring(o, r) for r in rings)
    other = [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 2.0)]
    for o in "<>":
        blob = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack(o + "BII", o == "<", 1006, 2) + polygon(o, [RING, other]) + polygon(o, [other])
        assert geopackage.rings(blob) == [RING, other]
    with pytest.raises(ValueError):
        geopackage.rings(b"XX")


def test_outlines_are_written_by_key(spark, tmp_path):
    rows = [(318, 1, "a", [{"x": x, "y": y} for x, y in RING]), (318, 2, None, [{"x": x, "y": y} for x, y in RING]), (319, 3, "c", [{"x": x, "y": y} for x, y in RING])]
    outlines = spark.createDataFrame(rows, f"aoi_id int, n_cells long, note string, ring {geopackage.RING}")
    done = geotiff.save(geopackage.files(outlines, "aoi_id", srs=32645), "aoi_id", tmp_path.as_uri(), "gpkg").collect()
    assert {r["aoi_id"] for r in done} == {318, 319}
    data = (tmp_path / "318.gpkg").read_bytes()
    assert sorted((p["n_cells"], p["note"]) for p, _ in geopackage.features(data)) == [(1, "a"), (2, None)]
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and db.execute("SELECT srs_id FROM gpkg_contents").fetchone()[0] == 32645
    assert outlines.agg(F.count("*")).first()[0] == 3
