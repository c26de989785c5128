"""Whole runs over the three-by-three season, stored and run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.detect import Otsu
from tidemark.plans.pipeline import Config, FloodRun

SCENES = {
    "S1A_IW_GRDH_1SDV_20240715T000000_20240715T000025_000001_000001_rtc": ("2024-07-15", {(0, 0): ("vv", 0.5)}),
    "S1A_IW_GRDH_1SDV_20240715T120000_20240715T120025_000002_000002_rtc": ("2024-07-15", {(1, 1): ("vh", 0.5)}),
    "S1A_IW_GRDH_1SDV_20240716T000000_20240716T000025_000003_000003_rtc": ("2024-07-16", {(0, 1): ("vv", None)}),
    "S1A_IW_GRDH_1SDV_20240717T000000_20240717T000025_000004_000004_rtc": ("2024-07-17", {(1, 0): ("both", 0.5)}),
}


def observations(spark):
    rows = []
    for k, v in enumerate((0.9, 1.1)):  # mean 1, deviation 0.1
        rows += [(318, f"dry{k}", datetime.date(2024, 4, 1 + k), r, c, v, v) for r in range(3) for c in range(3)]
    for name, (day, change) in SCENES.items():
        for r in range(3):
            for c in range(3):
                band, value = change.get((r, c), ("", 1.0))
                rows.append((318, name, datetime.date.fromisoformat(day), r, c, value if band in ("vv", "both") else 1.0, value if band in ("vh", "both") else 1.0))
    return spark.createDataFrame(rows, "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double")


def areas(spark):
    return spark.createDataFrame([(318, "45R", "04,05", 85.0, 25.0, 85.5, 25.5)], "aoi_id int, zone string, dry_month string, minx double, miny double, maxx double, maxy double")


def flat(spark, steep=()):
    return spark.createDataFrame([(318, r, c, 30.0 if (r, c) in steep else 0.0) for r in range(3) for c in range(3)], "aoi_id int, px_row int, px_col int, slope_deg double")


def start(spark, root, **more):
    run = FloodRun(spark, Config(str(root), dry_years=[2024], wet=("2024/07", "2024/07"), vv_thd=-2.5, vh_thd=-2.5, **more), areas(spark))
    if not run.store.exists("obs"):
        run.store.write("obs", observations(spark), ("px_row", "px_col"))
    return run


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    run = start(spark, tmp_path_factory.mktemp("run"))
    run.store.write("slope", flat(spark), ("px_row", "px_col"))
    run.run()
    return run


def at(df, row, col, value="cls", **where):
    d = df.filter((F.col("px_row") == row) & (F.col("px_col") == col))
    for k, v in where.items():
        d = d.filter(F.col(k) == v)
    return d.first()[value]


def test_season(spark, done):
    dates, months, valid = (done.store.read(t) for t in ("dates", "months", "valid"))
    assert at(dates, 0, 0, obs_date="2024-07-15") == 2 and at(dates, 1, 1, obs_date="2024-07-15") == 1
    assert at(dates, 0, 1, obs_date="2024-07-16") is None
    assert at(valid, 0, 0, "n_valid") == 4 and at(valid, 0, 1, "n_valid") == 3
    assert at(months, 1, 0, "flood_days") == 1 and at(months, 0, 1, "flood_days") == 0
    f = merge.fraction_flooded(months, valid)
    assert at(f, 1, 0, "fraction") == 0.25 and at(f, 0, 1, "fraction") == 0.0
    gaps = done.wet_observations().filter("vv is null or vh is null").count()
    assert gaps + valid.agg(F.sum("n_valid")).first()[0] == done.wet_observations().count()


def test_mapping_again_with_other_parameters(spark, done):
    assert done.map_floods(vv_thd=-10.0, vh_thd=-10.0).agg(F.max("cls")).first()[0] == 0
    assert done.map_floods().agg(F.max("cls")).first()[0] == 3
    smooth = done.map_floods(smooth=True)
    assert at(smooth, 1, 0, obs_date="2024-07-17") == 0


def test_steep_pixels_are_zero_also_over_gaps(spark, done):
    masked = merge.mask_slopes(done.map_floods(), flat(spark, {(1, 1), (0, 1)}), 20.0)
    assert at(masked, 1, 1, obs_date="2024-07-15") == 0 and at(masked, 0, 1, obs_date="2024-07-16") == 0


def test_a_second_run_does_nothing(spark, done, monkeypatch):
    again = start(spark, done.store.root)
    assert again.is_done(318)
    monkeypatch.setattr(again, "finish", lambda *_: pytest.fail("ran again"))
    assert again.run().count() == 9
    assert again.dry_ranges().collect() == []


def test_flush_keeps_results(spark, tmp_path):
    run = start(spark, tmp_path, polygons=True)
    run.store.write("slope", flat(spark))
    run.run()
    assert [r["n_cells"] for r in run.store.read("polygons").collect()] == [1]
    assert set(run.store.flush()) == {"obs", "classes"}
    assert run.store.exists("months") and run.store.exists("dates") and not run.store.exists("obs")


def test_otsu_fits_no_baseline(spark, tmp_path):
    run = start(spark, tmp_path, detector="otsu")
    assert isinstance(run.detector, Otsu)
    run.store.write("slope", flat(spark))
    run.run()
    assert not run.store.exists("baseline") and run.store.read("months").agg(F.max("flood_days")).first()[0] == 0


def test_ids_that_look_like_numbers_stay_text(spark, tmp_path):
    run = start(spark, tmp_path)
    run.store.write("obs", observations(spark).withColumn("scene_id", F.lit("007")), ("px_row", "px_col"))
    assert dict(run.store.read("obs").dtypes)["scene_id"] == "string"
    assert run.store.read("obs").filter("scene_id = '007'").count() == 54


def test_slope_stage(spark, tmp_path):
    run = start(spark, tmp_path)
    dem = spark.createDataFrame([(318, r, c, 3.0 * c) for r in range(-1, 4) for c in range(-1, 4)], "aoi_id int, px_row int, px_col int, elev double")
    run.prepare_slope(dem)
    assert 5.7 < at(run.store.read("slope"), 0, 0, "slope_deg") < 5.72


def test_config(spark, tmp_path):
    with pytest.warns(DeprecationWarning):
        assert Config.of({"root": "x", "rel_slope_thd": 12}).slope_thd == 12
    assert Config.of({"root": "x", "slope_thd": None}).slope_thd == 15.0
    with pytest.raises(ValueError):
        Config.of({"root": "x", "colour": 1})
    with pytest.raises(ValueError):
        FloodRun(spark, Config("x"))
    with pytest.raises(ValueError):
        FloodRun(spark, Config("x", area=(85, 25, 86, 26)))
    with pytest.raises(ValueError):
        FloodRun(spark, Config("x", detector="magic"), areas(spark))
    assert [r["mgrs_tile"] for r in FloodRun(spark, Config("x", area=(86.1, 25.4, 86.9, 26.1), dry_month="04,05")).areas.collect()] == ["45RVJ"]


def test_reads_only_what_is_missing(spark, tmp_path):
    from tidemark.sources.base import SceneCatalog

    names = list(SCENES)
    cat = spark.createDataFrame([(n, "sentinel-1-rtc", datetime.datetime.fromisoformat(SCENES[n][0]), 85.1, 25.1, 85.2, 25.2, {"vv": "a", "vh": "b"}) for n in names], "scene_id string, collection string, acquired timestamp_ntz, minx double, miny double, maxx double, maxy double, assets map<string,string>")
    asked = []

    def read(scenes, _):
        asked.append(sorted(r["scene_id"] for r in scenes.select("scene_id").collect()))
        return observations(spark)

    run = FloodRun(spark, Config(str(tmp_path), dry_years=[2024], wet=("2024/07", "2024/07")), areas(spark), SceneCatalog(cat), read)
    run.store.write("obs", observations(spark).filter(F.col("scene_id") == names[0]))
    run.prepare_wet()
    assert asked == [sorted(names[1:])]
    run.prepare_wet()
    assert len(asked) == 1 and run.store.scenes_done().count() == 4


def test_bucketed_tables_need_no_shuffle(spark):
    from tidemark.operators import baseline
    from tidemark.operators.detect import ZScore
    from tidemark.sources.store import use_buckets, write_bucketed

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    use_buckets(spark)
    try:
        write_bucketed(observations(spark), "obs_by_row", 4)
        stored = spark.table("obs_by_row")
        write_bucketed(baseline.fit(stored.filter("month(obs_date) = 4")), "base_by_row", 4)
        months = merge.by_month(merge.by_date(ZScore().detect(stored.filter("month(obs_date) = 7"), spark.table("base_by_row"))))
        assert "Exchange" not in months._jdf.queryExecution().executedPlan().toString()
        assert at(months, 1, 0, "flood_days") == 1 and months.count() == 9
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("drop table if exists obs_by_row")
        spark.sql("drop table if exists base_by_row")
