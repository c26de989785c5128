"""Ids, dates, zones, tiles and the scene catalog."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, text
from tidemark.operators import catalog, tiles
from tidemark.sources import geotiff, store
from tidemark.sources.base import BurstCatalog, SceneCatalog, read_items, with_retry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("month", "last"), [("2024/02", 29), ("2023/02", 28), ("2024/12", 31)])
def test_month_ends(spark, month, last):
    r = one(spark, text.month_range(F.lit(month), F.lit(month)))
    assert r["first"].day == 1 and r["last"].day == last


def test_date_range(spark):
    r = one(spark, text.date_range(F.lit("01/08/2023"), 10))
    assert (str(r["first"]), str(r["last"])) == ("2023-08-01", "2023-08-11")


@pytest.mark.parametrize(("key", "day"), [("S1A_IW_GRDH_1SDV_20240115T120000_20240115T120025_MPC_30_v1.0", "20240115"), ("OPERA_PASS_20240115", "20240115")])
def test_date_token(spark, key, day):
    assert one(spark, text.date_token(F.lit(key))) == day


def test_date_token_missing(spark):
    with pytest.raises(Exception, match="no date in id"):
        one(spark, text.date_token(F.lit("no_date_here_at_all")))
    assert one(spark, text.date_token(F.lit("no_date_here_at_all"), strict=False)) is None
    assert one(spark, text.date_token(F.lit(None).cast("string"))) is None


def test_file_name_and_tags(spark):
    assert one(spark, text.file_name(F.lit("S1A/IW:GRDH 20240115"))) == "S1A_IW_GRDH_20240115"
    assert one(spark, text.dry_months(F.lit("05, 04"))) == [4, 5]
    assert text.season_tag([2020, 2015], ["2020/07", "2020/09"]) == "DRY_2015_2020_WET_202007_202009"
    assert text.contiguous_years([2015, 2018]) == [2015, 2016, 2017, 2018]


@pytest.mark.parametrize(("zone", "epsg"), [("45R", 32645), ("45r", 32645), ("7N", 32607), ("7M", 32707), ("33C", 32733), ("60X", 32660)])
def test_zone_codes(spark, zone, epsg):
    assert one(spark, geo.zone_to_epsg(F.lit(zone))) == epsg


@pytest.mark.parametrize("zone", ["45I", "45O", "45Y", "45A", "R", "45"])
def test_bad_zones(spark, zone):
    with pytest.raises(Exception, match="no such zone"):
        one(spark, geo.zone_to_epsg(F.lit(zone)))


def test_latitude_bands(spark):
    for lat, band in ((-80.0, "C"), (0.0, "N"), (-0.1, "M"), (25.0, "R"), (83.9, "X"), (84.0, "X")):
        assert one(spark, geo.latitude_band(F.lit(lat))) == band
    with pytest.raises(Exception, match="latitude"):
        one(spark, geo.latitude_band(F.lit(84.1)))


def test_projection_against_known_point_and_back(spark):
    # The central meridian at the equator is the false origin; 3 degrees east of it is 833978.56 m at the equator.
    d = spark.createDataFrame([(87.0, 0.0), (90.0, 0.0)], "lon double, lat double").withColumns({"z": F.lit(45), "s": F.lit(False)})
    r = geo.apply(d, geo.utm_forward("lon", "lat", "z", "s")).collect()
    assert math.isclose(r[0]["easting"], 500000) and abs(r[0]["northing"]) < 1e-6
    assert math.isclose(r[1]["easting"], 833978.556919, abs_tol=1e-3)
    x, y = tiles.utm(90.0, 0.0, 45, False)
    assert math.isclose(x, r[1]["easting"], abs_tol=1e-6)
    m = geo.apply(d.withColumns({"lat": F.lit(25.0)}), [*geo.mollweide_forward("lon", "lat")])
    back = geo.apply(m.drop("lon", "lat"), geo.mollweide_inverse("mx", "my")).collect()
    assert all(math.isclose(b["lat"], 25.0, abs_tol=1e-8) for b in back) and math.isclose(back[0]["lon"], 87.0, abs_tol=1e-8)


def test_one_square_tile(spark):
    t = tiles.generate(spark, (86.1, 25.4, 86.9, 26.1)).collect()
    assert [(r["aoi_id"], r["mgrs_tile"], r["zone"], r["epsg"], r["dry_month"]) for r in t] == [(1, "45RVJ", "45R", 32645, "REQUIRED")]
    assert t[0]["xmax"] - t[0]["xmin"] == 100_000


def test_fishnet_tiles(spark):
    t = tiles.generate(spark, (85.0, 25.0, 85.5, 25.5), "utm_fishnet", 25).collect()
    assert 2 <= len(t) <= 12 and all(r["xmax"] - r["xmin"] == 25_000 for r in t)
    assert [r["aoi_id"] for r in t] == list(range(1, len(t) + 1))


def test_tiles_across_zones_bands_and_hemispheres(spark):
    assert {r["zone"][:2] for r in tiles.generate(spark, (83.5, 25.0, 84.5, 25.5)).collect()} == {"44", "45"}
    assert {r["zone"][2:] for r in tiles.generate(spark, (85.0, 23.5, 85.5, 24.5)).collect()} == {"Q", "R"}
    assert all(r["epsg"] // 100 == 327 for r in tiles.generate(spark, (30, -5, 31, -4)).collect())


def test_tile_errors(spark):
    with pytest.raises(ValueError):
        tiles.generate(spark, (0, 0, 1, 1), "hexagons")
    with pytest.raises(ValueError):
        tiles.generate(spark, (0, 0, 1, 1), "mgrs", 50)
    with pytest.raises(TypeError):
        tiles.generate(spark, "somewhere")


def test_rings(spark):
    box = geo.ring_literal([(0, 0), (2, 0), (2, 2), (0, 2)])
    assert one(spark, geo.inside(F.lit(1.0), F.lit(1.0), box)) and not one(spark, geo.inside(F.lit(3.0), F.lit(1.0), box))
    for pts, hit in (([(1, 1), (3, 1), (3, 3)], True), ([(0.5, 0.5), (1, 0.5), (1, 1)], True), ([(-1, -1), (5, -1), (5, 5), (-1, 5)], True), ([(3, 3), (4, 3), (4, 4)], False)):
        assert one(spark, geo.rings_meet(box, geo.ring_literal(pts))) is hit
    # A triangle whose bounds meet a box that it does not touch.
    assert one(spark, geo.ring_meets_box(geo.ring_literal([(0, 0), (10, 0), (0, 10)]), *map(F.lit, (8.0, 8.0, 9.0, 9.0)))) is False


def items(spark, ids):
    return spark.createDataFrame([(k, i, 0.0, 0.0, 1.0, 1.0) for k, i in enumerate(ids)], "arrival int, scene_id string, minx double, miny double, maxx double, maxy double")


def test_reprocessed_granule(spark):
    head = "OPERA_L2_RTC-S1_T001-BURST-IW1_20240115T000000Z_"
    d = items(spark, [head + "20240116T000000Z_S1A_30_v1.0", head + "20240118T000000Z_S1A_30_v1.0", head + "20240118T000000Z_S1A_30_v1.1", "plain_id"])
    got = sorted(r["scene_id"] for r in catalog.newest(d).collect())
    assert got == [head + "20240118T000000Z_S1A_30_v1.0", "plain_id"]


def test_passes(spark):
    b = "OPERA_L2_RTC-S1_{}_{}T000000Z_20240121T000000Z_S1A_30_v1.0"
    d = spark.createDataFrame([(b.format("B-IW2", 20240115), 2.0, 2.0, 3.0, 3.0), (b.format("A-IW1", 20240115), 0.0, 0.0, 1.0, 1.0), (b.format("C-IW1", 20240120), 0.0, 0.0, 1.0, 1.0)], "scene_id string, minx double, miny double, maxx double, maxy double")
    got = {r["scene_id"]: r for r in catalog.passes(d).collect()}
    assert set(got) == {"OPERA_PASS_20240115", "OPERA_PASS_20240120"}
    first = got["OPERA_PASS_20240115"]
    assert first["bursts"] == sorted(first["bursts"]) and (first["minx"], first["maxx"], first["maxy"]) == (0.0, 3.0, 3.0)


def test_matching(spark):
    box = "minx double, miny double, maxx double, maxy double"
    areas = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 50.0, 50.0, 51.0, 51.0)], f"aoi_id int, {box}")
    scenes = spark.createDataFrame([("scene1", 0.5, 0.5, 1.5, 1.5), ("wide", -20.0, -20.0, 20.0, 20.0), ("far", 10.0, 10.0, 11.0, 11.0)], f"scene_id string, {box}")
    p = catalog.match(areas, scenes)
    assert sorted((r["aoi_id"], r["scene_id"]) for r in p.collect()) == [(1, "scene1"), (1, "wide")]
    assert {r["aoi_id"]: r["scenes"] for r in catalog.scenes_of_areas(areas, p).collect()} == {1: ["scene1", "wide"], 2: []}
    none = catalog.match(areas, scenes.limit(0))
    assert {r["aoi_id"]: r["scenes"] for r in catalog.scenes_of_areas(areas, none).collect()} == {1: [], 2: []}
    assert catalog.areas_of_scenes(none).collect() == []


def test_matching_refines_by_rings(spark):
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    a = spark.createDataFrame([(1, 8.0, 8.0, 9.0, 9.0), (2, 1.0, 1.0, 2.0, 2.0)], "aoi_id int, minx double, miny double, maxx double, maxy double").withColumn("ring", geo.box_ring(*map(F.col, catalog.BOX)))
    s = spark.createDataFrame([("t", 0.0, 0.0, 10.0, 10.0)], "scene_id string, minx double, miny double, maxx double, maxy double").withColumn("ring", geo.ring_literal(tri))
    assert [(r["aoi_id"], r["scene_id"]) for r in catalog.match(a, s).collect()] == [(2, "t")]


def test_dry_window_spans_all_areas(spark):
    a = spark.createDataFrame([(1, "01"), (2, "12"), (3, "REQUIRED")], "aoi_id int, dry_month string")
    r = catalog.dry_window(a, [2019, 2020]).orderBy("year").collect()
    assert (str(r[1]["first"]), str(r[1]["last"])) == ("2020-01-01", "2020-12-31")
    assert catalog.dry_window(a.limit(0), [2020]).collect() == []


COLLECTION = {
    "type": "FeatureCollection",
    "features": [
        {"id": "a", "collection": "sentinel-1-rtc", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}, "assets": {"vv": {"href": "a_vv"}, "vh": {"href": "a_vh"}}, "properties": {"datetime": "2024-01-15T23:59:59Z", "proj:code": "EPSG:32645", "n": 3}},
        {"id": "b", "collection": "sentinel-1-rtc", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}, "assets": {"vv": {"href": "b_vv"}}, "properties": {"datetime": "2024-01-15T00:00:00Z", "proj:epsg": 32644}},
        {"id": "d", "collection": "nasadem", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}, "assets": {"elevation": {"href": "d_e"}}, "properties": {}},
    ],
}


def test_item_collections(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps(COLLECTION))
    c = read_items(spark, str(tmp_path / "items.json"))
    s = SceneCatalog(c)
    found = s.search((0.5, 0.5, 2, 2), "2024-01-15", "2024-01-15")
    got = found.select("scene_id", "epsg", *[h.alias(k) for h, k in zip(s.hrefs(), ("vv", "vh"))]).collect()
    assert [tuple(r) for r in got] == [("a", 32645, "a_vv", "a_vh")]
    assert s.search((0.5, 0.5, 2, 2), "2024-01-16", "2024-01-17").collect() == []
    assert [r["h"] for r in s.search_dem((0, 0, 1, 1)).select(s.dem_href().alias("h")).collect()] == ["d_e"]
    assert s.sign("x?old=1") == "x"
    with pytest.raises(NotImplementedError):
        BurstCatalog(c).hrefs()


def test_retry():
    seen, waits = [], []

    def read(href):
        seen.append(href)
        if len(seen) < 3:
            raise OSError("no")
        return href

    names = iter("abc")
    assert with_retry(read, lambda: next(names), sleep=waits.append) == "c"
    assert seen == ["a", "b", "c"] and waits == [20.0, 40.0]
    with pytest.raises(OSError):
        with_retry(lambda h: (_ for _ in ()).throw(OSError("no")), "x", attempts=2, sleep=waits.append)


def test_geotiff_round_trip(spark, tmp_path):
    v = np.arange(2 * 150 * 70, dtype=np.float32).reshape(2, 150, 70)
    v[0, 3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(geotiff.encode(v, ["202401", "202402"], 500000.0, 2800000.0, 30.0, 32645))
    head = geotiff.parse((tmp_path / "a.tif").read_bytes())
    assert head.shape == (2, 150, 70) and head.epsg == 32645 and head.names == ["202401", "202402"] and head.transform == (500000.0, 2800000.0, 30.0, 30.0)
    d = geotiff.read(spark, str(tmp_path / "*.tif"))
    assert d.count() == v.size and d.filter("value is null").count() == 1
    r = d.filter("band = '202402' and px_row = 149 and px_col = 69").first()
    assert r["value"] == v[1, 149, 69] and r["x"] == 500000 + 69.5 * 30
    window = (500000.0, 2800000 - 70 * 30.0, 500000 + 10 * 30.0, 2800000 - 66 * 30.0)
    w = geotiff.read(spark, str(tmp_path / "*.tif"), window)
    assert {(x["px_row"], x["px_col"]) for x in w.collect()} == {(r, c) for r in range(66, 70) for c in range(10)}
    assert len(list(geotiff.blocks((tmp_path / "a.tif").read_bytes(), window))) == 1


def test_geotiff_files_from_pixels(spark, tmp_path):
    px = spark.createDataFrame([(7, "202401", 0, 0, 3), (7, "202402", 1, 2, 255), (8, "202401", 0, 1, 1)], "aoi_id int, ym string, px_row int, px_col int, flood_days int")
    t = spark.createDataFrame([(7, 0.0, 0.0, 90.0, 60.0, 32645), (8, 90.0, 0.0, 180.0, 60.0, 32645)], "aoi_id int, xmin double, ymin double, xmax double, ymax double, epsg int")
    out = geotiff.save(geotiff.files(px, "aoi_id", "ym", "flood_days", t, 30.0), "aoi_id", f"file://{tmp_path}/maps").collect()
    assert len(out) == 2
    d = geotiff.read(spark, f"{tmp_path}/maps/7.tif")
    assert {(r["band"], r["px_row"], r["px_col"], r["value"]) for r in d.filter("value is not null").collect()} == {("202401", 0, 0, 3.0), ("202402", 1, 2, 255.0)}


def test_predictors():
    head = geotiff.Header("<", {339: (3,), 258: (32,), 317: (3,)})
    v = np.random.default_rng(0).normal(size=(4, 6, 1)).astype("<f4")
    raw = v[..., 0].astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    delta = np.diff(raw, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8)
    assert np.array_equal(geotiff._undo(delta.tobytes(), head, 4, 6, 1)[..., 0], v[..., 0])
    head = geotiff.Header("<", {339: (1,), 258: (16,), 317: (2,)})
    w = np.random.default_rng(0).integers(0, 60000, (4, 6, 2)).astype("<u2")
    delta = np.concatenate([w[:, :1], np.diff(w, axis=1)], axis=1).astype("<u2")
    assert np.array_equal(geotiff._undo(delta.tobytes(), head, 4, 6, 2), w)


def test_config_and_areas(spark, tmp_path):
    plain = "# run\nroot: /data/x  # here\naoi_ids:\n  - 1\n  - 2\nwet: ['2020/07', '2020/09']\nnested:\n  a: 1.5\n  b: true\nlast: null\n"
    expected = {"root": "/data/x", "aoi_ids": [1, 2], "wet": ["2020/07", "2020/09"], "nested": {"a": 1.5, "b": True}, "last": None}
    assert store._plain(plain) == expected and store.parse_config(json.dumps(expected)) == expected
    a = tiles.generate(spark, (86.1, 25.4, 86.9, 26.1))
    store.area_features(a).coalesce(1).write.text(str(tmp_path / "lines"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    (tmp_path / "grid.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(x) for x in lines]}))
    back = store.read_areas(spark, str(tmp_path / "grid.geojson")).first()
    assert (back["aoi_id"], back["zone"], back["dry_month"]) == (1, "45R", "REQUIRED") and len(back["ring"]) == 5
    assert isinstance(datetime.date.today(), datetime.date) and back["minx"] < 86.5 < back["maxx"]
