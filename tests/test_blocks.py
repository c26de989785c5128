"""Blocks, arrays, windows to read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, catalog
from tidemark.sources import geotiff

BOX = "minx double, miny double, maxx double, maxy double"


def test_blocks_and_back(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2, 11, 9)).round(3)
    v[0, 2, 3] = v[1, 2, 3] = np.nan
    v[0, 5, 5] = np.nan
    px = blocks.from_array(spark, v, ["vv", "vh"]).withColumn("scene_id", F.lit("s"))
    b = blocks.to_blocks(px, ["scene_id"], ["vv", "vh"], 4)
    assert b.count() == 9 and b.filter("size(vv) = 16").count() == 9
    back = {(r["px_row"], r["px_col"]): (r["vv"], r["vh"]) for r in blocks.from_blocks(b, ["scene_id"], ["vv", "vh"], 4).collect()}
    assert len(back) == 98 and back[5, 5][0] is None
    for (r, c), (x, y) in back.items():
        assert y == pytest.approx(v[1, r, c], rel=1e-6) and (x is None or x == pytest.approx(v[0, r, c], rel=1e-6))


def test_arrays(spark):
    assert blocks.from_array(spark, np.zeros((2, 3))).columns == ["px_row", "px_col", "value"]
    for bad in (np.zeros(3), np.zeros((1, 1, 1, 1))):
        with pytest.raises(ValueError):
            blocks.from_array(spark, bad)
    with pytest.raises(ValueError):
        blocks.from_array(spark, np.zeros((2, 3, 3)), ["one"])


def test_epsg(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "aoi_id int, x int")
    a = spark.createDataFrame([(1, "45R")], "aoi_id int, zone string")
    assert {r["aoi_id"]: r["epsg"] for r in blocks.with_epsg(t, a).collect()} == {1: 32645, 2: None}


def test_search_rings(spark):
    a = spark.createDataFrame([(1, 85.0, 25.0, 85.5, 25.5), (2, 86.0, 25.0, 86.5, 25.5)], f"aoi_id int, {BOX}")
    rings = {r["aoi_id"]: r["ring"] for r in catalog.search_rings(a).collect()}
    assert len(rings) == 2 and len(rings[1]) == 5 and rings[1][0] == rings[1][-1] and rings[1][2][:] == (85.5, 25.5)
    one = catalog.search_rings(a, separate=False).collect()
    assert [r["aoi_id"] for r in one] == [1] and one[0]["ring"][2][:] == (86.5, 25.5)
    wide = catalog.search_rings(a, buffer=500.0).filter("aoi_id = 1").first()["ring"]
    assert 0.004 < 85.0 - wide[0][0] < 0.02 and 0.004 < wide[2][1] - 25.5 < 0.02


def test_read_windows(spark):
    a = spark.createDataFrame([(1, 86.9, 25.0, 87.1, 25.1)], f"aoi_id int, {BOX}")
    s = spark.createDataFrame([("u", 32645), ("g", 4326), ("n", None)], "scene_id string, epsg int")
    p = spark.createDataFrame([(1, "u"), (1, "g"), (1, "n")], "aoi_id int, scene_id string")
    w = {r["scene_id"]: r for r in catalog.read_windows(p, a, s).collect()}
    assert w["g"]["x0"] is None and w["n"]["x0"] is None
    assert abs(w["u"]["x0"] + w["u"]["x1"] - 1_000_000) < 1e-3  # even around the central meridian
    assert 485_000 - 100 < w["u"]["x0"] < 485_000 and w["u"]["y1"] - w["u"]["y0"] > 10_000 + 11_000


def test_tiles_on_disk(spark, tmp_path):
    import os

    for name, age in (("a/tile_7_x.tif", 10), ("b/tile_7_y.tif", 5), ("a/tile_8.tif", 5), ("a/other.tif", 1)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
        os.utime(p, (1_700_000_000 - age, 1_700_000_000 - age))
    found = geotiff.list_tiles(spark, str(tmp_path), r"tile_([0-9]+)")
    got = {r["aoi_id"]: r["path"].rsplit("/", 1)[-1] for r in catalog.newest_files(found).collect()}
    assert got == {7: "tile_7_y.tif", 8: "tile_8.tif"}
