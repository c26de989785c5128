"""From files to months: headers, windows, overviews, projected reads, terrain, bursts, whole runs without a callback."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import neighbourhood, regrid
from tidemark.plans.pipeline import Config, FloodRun, run_one_aoi
from tidemark.sources import geotiff
from tidemark.sources.base import BurstCatalog, SceneCatalog
from tidemark.sources.reader import SceneReader, grids, interpolated

CELL = 30.0
BOX = (85.0, 25.0, 85.012, 25.008)  # about 41 x 30 pixels
CATALOG = "scene_id string, collection string, acquired timestamp_ntz, minx double, miny double, maxx double, maxy double, assets map<string,string>"


def counted(data):
    return geotiff.Ranged(lambda at, n: data[at : at + n])


@pytest.fixture(scope="module")
def large():
    rng = np.random.default_rng(4)
    return rng.uniform(-5, 5, (2, 1500, 1100)).astype(np.float32)


def test_a_file_reads_back_with_its_overviews(large):
    large = large.copy()
    large[0, 3, 4] = np.nan
    data = geotiff.encode(large, ["vv", "vh"], 1000.0, 2000.0, 10.0, 32645)
    full, *smaller = geotiff.headers(data)
    assert full.shape == (2, 1500, 1100) and full.names == ["vv", "vh"] and full.epsg == 32645 and full.transform == (1000.0, 2000.0, 10.0, 10.0)
    assert [h.shape for h in smaller] == [(2, 750, 550), (2, 375, 275), (2, 188, 138)] and smaller[0].transform == (1000.0, 2000.0, 20.0, 20.0) and smaller[0].epsg == 32645
    got = np.full(large.shape, 7.0, np.float32)
    for band, r, c, part in geotiff.blocks(data):
        assert band == 0
        got[:, r : r + part.shape[0], c : c + part.shape[1]] = part.transpose(2, 0, 1)
    assert np.array_equal(got, large, equal_nan=True)
    _, r0, c0, top = geotiff.array(data, (1000, -13000, 12000, 2000), 1)
    assert (r0, c0) == (0, 0) and np.array_equal(top, large[0, ::4, ::4][: top.shape[0], : top.shape[1]], equal_nan=True)


def test_windows_and_overviews_fetch_less(large):
    data = geotiff.encode(large, ["vv", "vh"], 1000.0, 2000.0, 10.0, 32645)
    window = (3000.0, -4000.0, 4000.0, -3000.0)
    whole, part, small = counted(data), counted(data), counted(data)
    head, r0, c0, values = geotiff.array(part, window)
    assert np.array_equal(values, large[0, r0 : r0 + values.shape[0], c0 : c0 + values.shape[1]]) and values.shape == (101, 101) and (r0, c0) == (500, 200)
    for _ in geotiff.blocks(whole):
        pass
    geotiff.array(small, (1000.0, -13000.0, 12000.0, 2000.0), 2)
    assert whole.fetched > 0.7 * len(data) and part.fetched < 0.25 * len(data) and small.fetched < 0.1 * len(data)
    assert geotiff.array(counted(data), (0.0, 5000.0, 10.0, 6000.0))[3].size == 0


def test_a_big_file_is_read():
    values = np.arange(12, dtype="<f4").reshape(3, 4)
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 32), (259, 3, 1), (273, 16, 400), (277, 3, 1), (278, 4, 3), (279, 16, 48), (339, 3, 3)]
    body = b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in tags)
    data = (b"II+\0" + struct.pack("<HHQ", 8, 0, 16) + struct.pack("<Q", len(tags)) + body + struct.pack("<Q", 0)).ljust(400, b"\0") + values.tobytes()
    assert geotiff.parse(data).shape == (1, 3, 4)
    assert np.array_equal(next(iter(geotiff.blocks(data)))[3][:, :, 0], values)


def test_interpolation_at_edges_and_gaps():
    v = np.array([[0.0, 1.0], [2.0, np.nan]])
    at = lambda x, y, how="bilinear": float(interpolated(v, np.array([x]), np.array([y]), (2, 2), (0, 0), how)[0])
    assert at(0.5, 0) == 0.5 and at(-0.4, 0) == 0 and at(0, 0.25) == 0.5 and at(0.4, 0.4, "nearest") == 0.0 and at(0.6, 0, "nearest") == 1.0
    assert all(np.isnan(at(*p)) for p in ((0.5, 0.5), (1, 1), (-0.6, 0), (0, 1.6)))


def areas(spark, aoi_ids=(318,)):
    rows = [(k, "45R", "04,05", *BOX) for k in aoi_ids]
    return spark.createDataFrame(rows, "aoi_id int, zone string, dry_month string, minx double, miny double, maxx double, maxy double")


def corner(spark, zone, margin=600.0):
    """Upper left corner, in a zone's metres, of a raster that covers the box."""
    t = spark.createDataFrame([(1, zone, False)], "aoi_id int, utm_zone int, south boolean").withColumn("ring", geo.box_ring(*map(F.lit, BOX)))
    b = regrid.tile_bounds(t, margin).first()
    return round(b["xmin"] / 10) * 10.0, round(b["ymax"] / 10) * 10.0, int((b["xmax"] - b["xmin"]) / 10) + 1, int((b["ymax"] - b["ymin"]) / 10) + 1


def written(folder, name, array, x0, y0, cell, epsg):
    path = folder / f"{name}.tif"
    path.write_bytes(geotiff.encode(array[None].astype(np.float32), ["b"], x0, y0, cell, epsg))
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two dry scenes, a wet one with water in the north-west quarter, one of them in the next zone, and terrain that rises to the east."""
    root = tmp_path_factory.mktemp("files")
    rng, rows = np.random.default_rng(2), []
    for name, day, zone, water in (("dry0", "2024-04-03", 45, False), ("dry1", "2024-05-09", 46, False), ("dry2", "2023-04-05", 45, False), ("wet", "2024-07-15", 46, True)):
        x0, y0, cols, rows_ = corner(spark, zone)
        power = {b: 10 ** (rng.normal(-8 if b == "vv" else -14, 0.3, (rows_, cols)) / 10) for b in ("vv", "vh")}
        if water:
            for v in power.values():
                v[: rows_ // 2, : cols // 2] = 10**-2.6
        power["vv"][5, 5] = 0.0
        links = {b: written(root, f"{name}-{b}", v, x0, y0, 10.0, 32600 + zone) for b, v in power.items()}
        rows.append((name, "sentinel-1-rtc", datetime.datetime.fromisoformat(day), BOX[0] - 0.01, BOX[1] - 0.01, BOX[2] + 0.01, BOX[3] + 0.01, links))
    step = 1 / 3600
    lon, lat = np.meshgrid(BOX[0] - 0.03 + np.arange(260) * step, BOX[3] + 0.03 - np.arange(240) * step)
    for k, cut in enumerate((slice(0, 150), slice(120, 260))):
        links = {"elevation": written(root, f"dem{k}", (100 + 50 * np.sin(lon * 900) + k)[:, cut], float(lon[0, cut.start] - step / 2), float(lat[0, 0] + step / 2), step, 4326)}
        rows.append((f"dem{k}", "nasadem", None, float(lon[0, cut.start]), float(lat[-1, 0]), float(lon[0, cut.stop - 1]), float(lat[0, 0]), links))
    return spark.createDataFrame(rows, CATALOG)


def test_reader_and_joins_give_the_same(spark, folder):
    """The numeric kernel against inverse and forward projection as SQL, weights as a table, and a join."""
    reader = SceneReader(spark, SceneCatalog(folder), CELL, level=None, attempts=1)
    got = {(r["px_row"], r["px_col"]): (r["vv"], r["vh"]) for r in reader(folder.filter("scene_id = 'wet'"), areas(spark)).collect()}
    a = grids(areas(spark), CELL).first()
    assert len(got) == a["n_rows"] * a["n_cols"]
    t = grids(areas(spark), CELL).withColumn("xmax", F.col("xmin") + F.col("n_cols") * CELL).withColumn("ymin", F.col("ymax") - F.col("n_rows") * CELL)
    p = geo.apply(regrid.lattice(t, CELL), geo.utm_inverse("x", "y", "utm_zone", "south"))
    p = geo.apply(p.withColumn("utm_zone", F.lit(46)), geo.utm_forward("lon", "lat", "utm_zone", "south"))
    for k, band in enumerate(("vv", "vh")):
        path = folder.filter("scene_id = 'wet'").first()["assets"][band]
        x0, y0, sx, _ = geotiff.parse(open(path, "rb").read()).transform
        source = geotiff.read(spark, path).select(F.col("px_row").alias("src_row"), F.col("px_col").alias("src_col"), F.when(F.col("value") > 0, F.log10("value") * 10).alias("v"), F.lit("wet").alias("scene_id"))
        rows, cols = source.agg(F.max("src_row") + 1, F.max("src_col") + 1).first()
        w = regrid.weights(p, (F.col("easting") - x0) / sx - 0.5, (F.lit(y0) - F.col("northing")) / sx - 0.5, cols, rows)
        want = {(r["px_row"], r["px_col"]): r["v"] for r in regrid.regrid(source, w, ("v",)).collect()}
        assert set(want) == set(got) and sum(v is not None for v in want.values()) > 1000
        assert all((v is None) == (got[q][k] is None) and (v is None or abs(v - got[q][k]) < 1e-5) for q, v in want.items())


def test_a_run_without_a_callback(spark, folder, tmp_path):
    run = FloodRun(spark, Config(str(tmp_path), dry_years=[2023, 2024], wet=("2024/07", "2024/07"), cell=CELL, scene_level=0, slope_thd=90.0), areas(spark), SceneCatalog(folder))
    months = {(r["px_row"], r["px_col"]): r["flood_days"] for r in run.run().collect()}
    a = grids(areas(spark), CELL).first()
    assert len(months) == a["n_rows"] * a["n_cols"] and set(months.values()) == {0, 1}
    wet = [q for q, v in months.items() if v]
    near = lambda q: q[0] < a["n_rows"] / 2 - 2 and q[1] < a["n_cols"] / 2 - 2
    dry = [q for q in months if q[0] > a["n_rows"] / 2 + 2 or q[1] > a["n_cols"] / 2 + 2]
    assert all(q in wet for q in months if near(q)) and sum(q in wet for q in dry) <= 0.02 * len(dry)  # three scenes make a noisy deviation
    assert run.store.read("obs").select("scene_id").distinct().count() == 4
    slopes = run.store.read("slope")
    assert slopes.count() == len(months) and 0 < slopes.agg(F.max("slope_deg")).first()[0] < 90


def test_terrain_is_mosaicked_with_its_margin(spark, folder):
    reader = SceneReader(spark, SceneCatalog(folder), CELL, dem_level=None, attempts=1)
    got = {last: {(r["px_row"], r["px_col"]): r["elev"] for r in reader.terrain(areas(spark), 500.0, last).collect()} for last in (True, False)}
    a, m = grids(areas(spark), CELL, 500.0).first(), 17
    assert a["margin"] == m and set(got[True]) == {(r, c) for r in range(-m, a["n_rows"] + m) for c in range(-m, a["n_cols"] + m)}
    gaps = [round(got[True][q] - got[False][q], 3) for q in got[True]]
    assert {0.0, 1.0} <= set(gaps) and sum(g in (0.0, 1.0) for g in gaps) > 0.9 * len(gaps)  # where both items reach, the second is one metre higher; at an edge the edge counts
    p = geo.apply(spark.createDataFrame([(0, 45, False, float(a["xmin"]), float(a["ymax"]))], "k int, utm_zone int, south boolean, x double, y double"), geo.utm_inverse("x", "y", "utm_zone", "south")).first()
    assert abs(got[False][0, 0] - (100 + 50 * np.sin(p["lon"] * 900))) < 1.5
    slopes = neighbourhood.slope(reader.terrain(areas(spark), 500.0), CELL)
    assert slopes.filter(F.col("px_row").between(0, a["n_rows"] - 1)).agg(F.min("slope_deg")).first()[0] >= 0


def test_bursts_of_a_pass_are_one_scene(spark, tmp_path):
    x0, y0, cols, rows = corner(spark, 45)
    made = []
    for k, cut in enumerate((slice(0, cols // 2 + 5), slice(cols // 2 - 5, cols))):
        v = np.full((rows, cols), 0.1 * (k + 1))[:, cut]
        links = {b: written(tmp_path, f"b{k}{b}", v, x0 + cut.start * 10, y0, 10.0, 32645) for b in ("0_VV", "0_VH")}
        made.append((f"OPERA_L2_RTC-S1_T012-0250{k}-IW1_20240715T000000Z_20240716T00000{k}Z_S1A", "OPERA_L2_RTC-S1_V1", datetime.datetime(2024, 7, 15), *BOX, links, k))
    source = BurstCatalog(spark.createDataFrame(made, CATALOG + ", arrival int"))
    scenes = source.search(BOX, "2024-07-01", "2024-07-31")
    reader = SceneReader(spark, source, CELL, level=None, attempts=1)
    got = reader(scenes, areas(spark)).collect()
    a = grids(areas(spark), CELL).first()
    assert len(got) == a["n_rows"] * a["n_cols"] and {r["scene_id"] for r in got} == {"OPERA_PASS_20240715"} and {str(r["obs_date"]) for r in got} == {"2024-07-15"}
    west, east = (round(float(10 * np.log10(np.float32(v))), 4) for v in (0.1, 0.2))
    middle = x0 + cols // 2 * 10
    for r in got:
        x = a["xmin"] + r["px_col"] * CELL
        assert round(r["vv"], 4) == (west if x < middle - 60 else east) or abs(x - middle) <= 60


def test_dry_years_have_baselines_of_their_own(spark, tmp_path):
    """Two settings in one folder give what two folders give."""
    rows = []
    for year, v in ((2019, (0.9, 1.1)), (2020, (0.8, 1.2)), (2024, (1.9, 2.1))):
        rows += [(318, f"dry{year}{k}", datetime.date(year, 4, 1 + k), r, 0, x, x) for k, x in enumerate(v) for r in range(3)]
    rows += [(318, "wet", datetime.date(2024, 7, 15), r, 0, x, x) for r, x in enumerate((0.5, 1.0, 2.0))]
    obs = spark.createDataFrame(rows, "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double")

    def months(root, years):
        run = FloodRun(spark, Config(str(root), dry_years=years, wet=("2024/07", "2024/07")), areas(spark))
        if not run.store.exists("obs"):
            run.store.write("obs", obs)
            run.store.write("slope", spark.createDataFrame([(318, r, 0, 0.0) for r in range(3)], "aoi_id int, px_row int, px_col int, slope_deg double"))
        return sorted((r["px_row"], r["flood_days"]) for r in run.run().collect())

    one, two = months(tmp_path / "a", [2024]), months(tmp_path / "b", [2019, 2020])
    assert one != two
    assert months(tmp_path / "c", [2024]) == one and months(tmp_path / "c", [2019, 2020]) == two and months(tmp_path / "c", [2024]) == one


def test_one_area_by_its_settings(spark, folder, tmp_path):
    text = f"root: {tmp_path}/run\ngrid: {tmp_path}/grid.json\ndry_years: [2023, 2024]\nwet: [2024/07, 2024/07]\nrel_slope_thd: 90\nscene_level: 0\n"
    ring = [[BOX[0], BOX[1]], [BOX[2], BOX[1]], [BOX[2], BOX[3]], [BOX[0], BOX[3]], [BOX[0], BOX[1]]]
    features = ",".join(f'{{"type":"Feature","properties":{{"ID":"{k}","zone":"45R","dry_month":"04,05"}},"geometry":{{"type":"Polygon","coordinates":[{ring}]}}}}' for k in (317, 318))
    (tmp_path / "grid.json").write_text(f'{{"type":"FeatureCollection","features":[{features}]}}')
    with pytest.warns(DeprecationWarning):
        out = run_one_aoi(spark, text, 318, SceneCatalog(folder))
    assert {r["aoi_id"] for r in out.collect()} == {318} and out.agg(F.max("flood_days")).first()[0] == 1
