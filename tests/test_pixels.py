"""Operators on pixels over small rasters with known answers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import classes as cl
from tidemark.functions import radiometry as rad
from tidemark.operators import baseline, duration, merge, neighbourhood, regrid, summaries, vectorise
from tidemark.operators.detect import Detector, Otsu, ZScore, otsu_thresholds

OBS = "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double"


def obs(spark, rows):
    d = spark.createDataFrame([(a, s, d, r, c, v, h) for a, s, d, r, c, v, h in rows], OBS.replace("obs_date date", "obs_date string"))
    return d.withColumn("obs_date", F.to_date("obs_date"))


def raster(spark, table, scene="s", date="2024-01-15"):
    rows = [(1, scene, date, r, c, None if v is None else int(v)) for r, line in enumerate(table) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "aoi_id int, scene_id string, obs_date string, px_row int, px_col int, cls int").withColumn("obs_date", F.to_date("obs_date"))


def grid(df, value="cls"):
    return {(r["px_row"], r["px_col"]): r[value] for r in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decibels(spark):
    assert one(spark, rad.linear_to_decibel(F.lit(10.0))) == 10.0
    assert one(spark, rad.linear_to_decibel(F.lit(0.0))) is None
    assert one(spark, rad.linear_to_decibel(F.lit(-1.0))) is None
    assert one(spark, rad.decibel_to_linear(F.lit(10.0))) == 10.0
    assert one(spark, rad.calibrated(F.lit(float("nan")))) is None
    assert one(spark, rad.below_nodata(F.lit(17.0))) is None
    assert one(spark, rad.below_nodata(F.lit(16.99))) == 16.99
    assert one(spark, rad.scrub(F.lit(3.4028234663852886e38))) is None
    assert one(spark, rad.stretched(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0


@pytest.mark.parametrize(("vv", "vh", "cls"), [(0, 0, 0), (0, -3, 1), (-3, 0, 2), (-3, -3, 3), (-2, -2, 0), (None, -3, None), (0, None, None)])
def test_classes(spark, vv, vh, cls):
    one_, zero = F.lit(1.0), F.lit(0.0)
    low = lambda v: cl.is_low(F.lit(v).cast("double"), zero, one_, -2.0)
    assert one(spark, cl.flood_class(low(vv), low(vh))) == cls


def test_zero_deviation(spark):
    for x, expected in ((0.9, True), (1.1, False), (1.0, None)):
        assert one(spark, cl.is_low(F.lit(x), F.lit(1.0), F.lit(0.0), -2.5)) is expected


def test_gap_unaware_classes(spark):
    low = F.lit(None).cast("boolean")
    assert one(spark, cl.flood_class(low, F.lit(True), gap_aware=False)) == 1


def test_slope_mask_writes_zero_over_gaps_and_unknown_slopes(spark):
    for cls, slope, expected in ((3, 10.0, 3), (3, 15.0, 0), (None, 30.0, 0), (None, 1.0, None), (3, None, 0)):
        assert one(spark, cl.slope_masked(F.lit(cls).cast("int"), F.lit(slope).cast("double"), 15.0)) == expected


def test_baseline_skips_gaps_and_folds(spark):
    random.seed(0)
    rows = [(1, f"s{k}", "2024-04-01", r, c, None if (r, c) == (0, 0) or random.random() < 0.2 else random.gauss(1, 0.1), random.gauss(2, 0.2)) for k in range(5) for r in range(8) for c in range(8)]
    d = obs(spark, rows)
    frame = pd.DataFrame(rows, columns=["a", "s", "d", "r", "c", "vv", "vh"])
    whole = {(r["px_row"], r["px_col"]): r for r in baseline.fit(d).collect()}
    parts = baseline.fold([d.filter(F.col("scene_id") == f"s{k}") for k in range(5)])
    folded = {(r["px_row"], r["px_col"]): r for r in parts.collect()}
    assert whole[0, 0]["vv_mean"] is None and whole[0, 0]["vv_std"] is None and whole[0, 0]["n_vv"] == 0
    for (r, c), g in frame.groupby(["r", "c"]):
        for b in ("vv", "vh"):
            v = g[b].dropna()
            if len(v):
                for got in (whole[r, c], folded[r, c]):
                    assert math.isclose(got[f"{b}_mean"], v.mean(), rel_tol=1e-8)
                    assert math.isclose(got[f"{b}_std"], v.std(ddof=0), rel_tol=1e-6, abs_tol=1e-9)
    assert folded[0, 0]["vv_std"] is None


def scene(spark, values_vv, values_vh, name="w"):
    n = values_vv.shape
    r, c = np.indices(n)
    frame = pd.DataFrame({"aoi_id": 1, "scene_id": name, "px_row": r.ravel(), "px_col": c.ravel(), "vv": values_vv.ravel(), "vh": values_vh.ravel()})
    d = spark.createDataFrame(frame)
    return d.select(F.col("aoi_id").cast("int"), "scene_id", F.col("px_row").cast("int"), F.col("px_col").cast("int"), rad.no_nan(F.col("vv")).alias("vv"), rad.no_nan(F.col("vh")).alias("vh"))


@pytest.mark.parametrize("detector", [ZScore(), Otsu()])
def test_detector_contract(spark, detector):
    rng = np.random.default_rng(1)
    n = 100
    land = lambda: rng.normal(1, 0.02, (n, n))
    wet = land()
    wet[:, : n // 2] = rng.normal(0.1, 0.01, (n, n // 2))
    wet_vh = land()
    wet_vh[:, : n // 2] = rng.normal(0.1, 0.01, (n, n // 2))
    dry = scene(spark, land(), land(), "d0")
    for k in range(1, 4):
        dry = dry.unionByName(scene(spark, land(), land(), f"d{k}"))
    assert isinstance(detector, Detector)
    base = detector.fit(dry)
    assert (base is not None) == detector.requires_baseline
    out = detector.detect(scene(spark, wet, wet_vh), base)
    share = {r["half"]: r for r in out.groupBy((F.col("px_col") < n // 2).alias("half")).agg(F.avg((F.col("cls") == 3).cast("int")).alias("w"), F.avg((F.col("cls") == 0).cast("int")).alias("d"), F.count("*").alias("n")).collect()}
    assert share[True]["w"] > 0.8 and share[False]["d"] > 0.8
    assert share[True]["n"] + share[False]["n"] == n * n
    assert {r["cls"] for r in out.select("cls").distinct().collect()} <= {0, 1, 2, 3}


def test_otsu_degenerate_scenes(spark):
    rng = np.random.default_rng(13)
    cases = {
        "gaps": np.full((10, 10), np.nan), "small": rng.normal(-12, 2, (5, 5)), "unimodal": rng.normal(-12, 1.5, (200, 200)), "constant": np.full((20, 20), -12.0),
    }
    d = None
    for name, v in cases.items():
        s = scene(spark, v, v, name)
        d = s if d is None else d.unionByName(s)
    cuts = {r["scene_id"]: r for r in otsu_thresholds(d).collect()}
    assert all(r["vv_threshold"] is None and r["vh_threshold"] is None for r in cuts.values())
    out = {(r["scene_id"], r["cls"]) for r in Otsu().detect(d).select("scene_id", "cls").distinct().collect()}
    assert out == {("gaps", None), ("small", 0), ("unimodal", 0), ("constant", 0)}


def test_otsu_threshold_is_a_bin_centre_between_the_modes(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(-10, 1, 20000), rng.normal(-22, 0.5, 20000)]).reshape(200, 200)
    d = scene(spark, v, v)
    got = otsu_thresholds(d).first()["vv_threshold"]
    counts, edges = np.histogram(v, 256)
    mid = (edges[:-1] + edges[1:]) / 2
    w0, w1 = np.cumsum(counts)[:-1], counts.sum() - np.cumsum(counts)[:-1]
    m0, m1 = np.cumsum(counts * mid)[:-1] / w0, ((counts * mid).sum() - np.cumsum(counts * mid)[:-1]) / w1
    assert math.isclose(got, mid[np.argmax(w0 * w1 * (m0 - m1) ** 2)], rel_tol=1e-9)


def test_merge_by_date_is_poisoned_by_gaps(spark):
    a, b, c = raster(spark, [[0, 1], [3, 0]], "a"), raster(spark, [[3, 0], [0, 0]], "b"), raster(spark, [[None, 0], [0, 0]], "c", "2024-01-16")
    d = raster(spark, [[3, 3], [3, 3]], "d", "2024-01-16")
    out = merge.by_date(a.unionByName(b).unionByName(c).unionByName(d))
    got = {(str(r["obs_date"]), r["px_row"], r["px_col"]): r["cls"] for r in out.collect()}
    assert [got["2024-01-15", r, k] for r in (0, 1) for k in (0, 1)] == [3, 1, 3, 0]
    assert got["2024-01-16", 0, 0] is None and got["2024-01-16", 0, 1] == 3
    assert grid(merge.season_max(out))[0, 0] == 3


def test_monthly_counts(spark):
    dates = [("2024-01-15", [[3, 1], [0, None]]), ("2024-01-20", [[3, 3], [0, None]]), ("2024-02-10", [[1, 0], [3, None]])]
    d = None
    for day, t in dates:
        r = raster(spark, t, day, day)
        d = r if d is None else d.unionByName(r)
    m = merge.by_month(merge.by_date(d))
    got = {(r["ym"], r["px_row"], r["px_col"]): r["flood_days"] for r in m.collect()}
    assert [got["202401", r, c] for r in (0, 1) for c in (0, 1)] == [2, 1, 0, 255]
    assert [got["202402", r, c] for r in (0, 1) for c in (0, 1)] == [0, 0, 1, 255]
    wide = merge.months_wide(m, ["202402", "202401"])
    assert wide.columns[-2:] == ["m202401", "m202402"]
    assert {r["bin"] for r in m.withColumn("bin", cl.flood_days_bin(F.col("flood_days"))).collect()} == {None, 0, 1}


def test_a_gap_and_a_flooded_date_count_one(spark):
    d = raster(spark, [[3]], "a", "2024-01-01").unionByName(raster(spark, [[None]], "b", "2024-01-02"))
    assert merge.by_month(merge.by_date(d)).first()["flood_days"] == 1


@pytest.mark.parametrize(("run", "longest", "events"), [("11100", 3, 1), ("1001110", 3, 2), ("10101", 1, 3), ("0000", 0, 0), ("1111", 4, 1)])
def test_duration(spark, run, longest, events):
    rows = [(1, f"2024-01-{k + 1:02d}", 0, 0, 3 * int(v)) for k, v in enumerate(run)]
    d = spark.createDataFrame(rows, "aoi_id int, obs_date string, px_row int, px_col int, cls int").withColumn("obs_date", F.to_date("obs_date"))
    r = duration.flood_runs(d).first()
    assert (r["max_run"], r["n_events"]) == (longest, events)


def test_majority(spark):
    t = [[3 if c >= 4 else 0 for c in range(7)] for _ in range(7)]
    t[2][1] = 3
    out = grid(neighbourhood.majority(raster(spark, t), 3))
    assert out[2, 1] == 0 and out[3, 4] == 3 and out[3, 3] == 0
    hole = [[2] * 5 for _ in range(5)]
    hole[2][2] = None
    assert grid(neighbourhood.majority(raster(spark, hole), 3))[2, 2] == 2
    block = [[None if 1 <= r < 4 and 1 <= c < 4 else 1 for c in range(7)] for r in range(7)]
    out = grid(neighbourhood.majority(raster(spark, block), 3))
    assert out[2, 2] is None and out[1, 1] == 1
    wide = [[None if 3 <= r < 6 and 3 <= c < 6 else 2 for c in range(9)] for r in range(9)]
    assert grid(neighbourhood.majority(raster(spark, wide), 3))[4, 4] is None
    assert grid(neighbourhood.majority(raster(spark, wide), 5))[4, 4] == 2
    for bad in (4, 0, -1):
        with pytest.raises(ValueError):
            neighbourhood.majority(raster(spark, hole), bad)


def test_majority_over_missing_pixels_against_brute_force(spark):
    random.seed(3)
    cells = {(r, c): random.choice([0, 1, 2, 3, None]) for r in range(12) for c in range(12) if random.random() < 0.6}
    d = spark.createDataFrame([(1, "s", r, c, v) for (r, c), v in cells.items()], "aoi_id int, scene_id string, px_row int, px_col int, cls int")
    got = grid(neighbourhood.majority(d, 5))
    for r, c in cells:
        near = [v for (a, b), v in cells.items() if abs(a - r) <= 2 and abs(b - c) <= 2 and v is not None]
        assert got[r, c] == (min(set(near), key=lambda v: (-near.count(v), v)) if near else None)


def test_slope_of_a_ramp(spark):
    d = spark.createDataFrame([(1, r, c, 3.0 * c) for r in range(5) for c in range(5)], "aoi_id int, px_row int, px_col int, elev double")
    s = grid(neighbourhood.slope(d, 30.0), "slope_deg")
    assert math.isclose(s[2, 2], math.degrees(math.atan(0.1)), rel_tol=1e-12)
    assert s[0, 0] == 0.0
    assert grid(neighbourhood.slope(d, 30.0, None), "slope_deg")[0, 0] is None


def test_regions(spark):
    r = vectorise.regions(raster(spark, [[0, 1, 2], [3, 3, 0], [1, 2, 3]]), 1.0).collect()
    assert sorted(x["n_cells"] for x in r) == [1, 2] and sum(x["area_m2"] for x in r) == 3
    assert vectorise.regions(raster(spark, [[0, 1], [2, 1]])).collect() == []


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def test_region_outlines_have_the_cells_area(spark):
    random.seed(5)
    t = [[3 if random.random() < 0.6 else 0 for _ in range(20)] for _ in range(20)]
    t[5][5:10], t[9][5:10] = [3] * 5, [3] * 5
    for row in range(5, 10):
        t[row][5] = t[row][9] = 3
    t[7][7] = 0
    for r in vectorise.regions(raster(spark, t), 1.0).collect():
        rings = [[tuple(map(float, p.split())) for p in part.split(", ")] for part in r["wkt"][len("POLYGON (("):-2].split("), (")]
        assert all(ring[0] == ring[-1] for ring in rings)
        assert math.isclose(abs(sum(_area(ring) for ring in rings)), r["n_cells"])


def test_regions_against_flood_fill(spark):
    random.seed(6)
    t = [[3 if random.random() < 0.55 else 0 for _ in range(30)] for _ in range(30)]
    todo, sizes = {(r, c) for r in range(30) for c in range(30) if t[r][c] == 3}, []
    while todo:
        front, n = [todo.pop()], 0
        while front:
            r, c = front.pop()
            n += 1
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in todo:
                    todo.remove(p)
                    front.append(p)
        sizes.append(n)
    assert sorted(x["n_cells"] for x in vectorise.regions(raster(spark, t)).collect()) == sorted(sizes)


def test_lattice_keys(spark):
    tile = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 61.0)], "aoi_id int, xmin double, ymin double, xmax double, ymax double")
    rows = regrid.lattice(tile, 30.0).collect()
    assert {(r["px_row"], r["px_col"]) for r in rows} == {(r, c) for r in range(3) for c in range(4)}
    assert max(r["y"] for r in rows) == 61.0 and min(r["y"] for r in rows) == 1.0


def test_bilinear_reproduces_a_plane_and_keeps_gaps(spark):
    source = spark.createDataFrame([("s", r, c, 2.0 * c + 3.0 * r, None if (r, c) == (2, 2) else 1.0) for r in range(6) for c in range(6)], "scene_id string, src_row int, src_col int, vv double, vh double")
    px = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(4)], "aoi_id int, px_row int, px_col int")
    w = regrid.weights(px, F.col("px_col") * 1.25 + 0.25, F.col("px_row") * 1.25 + 0.25, 6, 6)
    out = regrid.regrid(source, w).collect()
    assert len(out) == 16
    for r in out:
        assert math.isclose(r["vv"], 2 * (r["px_col"] * 1.25 + 0.25) + 3 * (r["px_row"] * 1.25 + 0.25), rel_tol=1e-12)
        near = all(abs(r[k] * 1.25 + 0.25 - 2) < 1 for k in ("px_row", "px_col"))
        assert (r["vh"] is None) == near
    assert regrid.weights(px, F.lit(-3.0), F.lit(99.0), 6, 6).select("src_row", "src_col").distinct().collect()[0][:] == (5, 0)
    with pytest.raises(ValueError):
        regrid.weights(px, F.lit(0.0), F.lit(0.0), 6, 6, "cubic")


def test_mosaic_order(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, None), (2, 1, None)], "k int, o int, v double")
    assert regrid.mosaic(d, ["k"], "v", "o").collect()[0]["v"] == 7.0
    assert regrid.mosaic(d, ["k"], "v", "o", last=False).collect()[0]["v"] == 5.0


def test_agreement_of_equal_products(spark):
    m = spark.createDataFrame([(1, 0, 0, "202401", 3), (1, 0, 1, "202401", 255)], "aoi_id int, px_row int, px_col int, ym string, flood_days int")
    r = summaries.agreement(m, m).first()
    assert (r["n_both"], r["n_either"], r["exact_pct"], r["mean_diff"], r["std_diff"]) == (1, 1, 100.0, 0.0, 0.0)


def test_agreement_is_over_common_months(spark):
    kind = "aoi_id int, px_row int, px_col int, ym string, flood_days int"
    a = spark.createDataFrame([(1, 0, 0, "202401", 3), (1, 0, 1, "202401", 1), (1, 0, 0, "202402", 1)], kind)
    b = spark.createDataFrame([(1, 0, 0, "202401", 1), (1, 0, 2, "202401", 4), (1, 0, 0, "202403", 1)], kind)
    r = summaries.agreement(a, b).collect()
    assert [(x["ym"], x["n_both"], x["n_either"], x["exact_pct"], x["within_one_pct"], x["mean_diff"]) for x in r] == [("202401", 1, 3, 0.0, 0.0, 2.0)]


def test_clip_limits_without_values(spark):
    d = spark.createDataFrame([(1, None), (1, None)], "g int, x double")
    r = summaries.clip_limits(d, ["x"], ["g"]).first()
    assert (r["x_low"], r["x_high"]) == (0.0, 1.0)


def test_year_total_needs_a_valid_month(spark):
    m = spark.createDataFrame([(1, 0, 0, "202401", 255), (1, 0, 1, "202401", 2), (1, 0, 1, "202402", 255)], "aoi_id int, px_row int, px_col int, ym string, flood_days int")
    got = {r["px_col"]: r["flood_days"] for r in summaries.year_totals(m).collect()}
    assert got == {0: None, 1: 2}
    a = summaries.area_by_year(m).first()
    assert a["n_pixels"] == 1 and math.isclose(a["area_km2"], 0.0009)


def test_thinning(spark):
    assert neighbourhood.thinning_factor(3500, 1000) == 4 and neighbourhood.thinning_factor(10, 100) == 1
    d = raster(spark, [[0, 1, 2, 3]] * 4)
    assert len(neighbourhood.thinned(d, 2).collect()) == 4
