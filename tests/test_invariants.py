"""What must hold for any observations, and what plans must not hold."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import baseline, merge
from tidemark.operators.detect import ZScore
from tidemark.plans.queries import QUERIES

SCHEMA = "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double"
value = st.one_of(st.none(), st.floats(-30, 16, allow_nan=False).map(lambda v: round(v, 2)))
row = st.tuples(st.integers(0, 1), st.integers(0, 5), st.integers(0, 2), st.integers(0, 1), value, value)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40, unique_by=lambda r: r[:4]))
def test_counts_add_up(spark, rows):
    day = lambda d: datetime.date(2024, 4 + 3 * (d // 3), 1 + d % 3)
    data = [(a, f"s{d}", day(d), r, c, v, h) for a, d, r, c, v, h in rows]
    obs = spark.createDataFrame(data, SCHEMA)
    dry, wet = obs.filter(F.month("obs_date") == 4), obs.filter(F.month("obs_date") == 7)
    stats = baseline.fit(dry)
    for r in stats.collect():
        assert (r["vv_mean"] is None) == (r["n_vv"] == 0) and (r["vv_std"] is None or r["vv_std"] >= 0)
    classes = ZScore(-1.0, -1.0).detect(wet, stats)
    assert classes.count() == wet.count()
    got = classes.agg(F.count("cls").alias("n"), F.count_if(F.col("cls").isNull()).alias("gaps")).first()
    assert got["n"] + got["gaps"] == len([x for x in data if x[2].month == 7])
    dates = merge.by_date(classes)
    months = {(r["aoi_id"], r["px_row"], r["px_col"]): r["flood_days"] for r in merge.by_month(dates).collect()}
    seen = {(r["aoi_id"], r["px_row"], r["px_col"]): r["n"] for r in dates.groupBy("aoi_id", "px_row", "px_col").agg(F.count("cls").alias("n")).collect()}
    assert set(months) == set(seen)
    assert all(months[k] == 255 if seen[k] == 0 else 0 <= months[k] <= seen[k] for k in months)


@pytest.mark.parametrize("name", ["area_scene_pairs", "slope_masked_classes", "regrid_bilinear", "cache_split", "product_agreement", "otsu_classes", "majority_filter"])
def test_joins_are_by_equality(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    physical = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from tidemark.operators import catalog
    from tidemark.plans import views

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    c = views.table(spark, DATA, "orders").selectExpr("o_orderkey as scene_id", "o_orderstatus as collection", "o_orderdate as acquired", "o_totalprice as minx", "o_totalprice as maxx", "o_totalprice as miny", "o_totalprice as maxy", "map('vv', 'a', 'vh', 'b') as assets", "o_orderpriority as unused")
    plan = catalog.search(c, "F", (0, 0, 1000, 1000), "1995-01-01", "1995-12-31").select("scene_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_totalprice,1000.0)" in plan
    assert "o_orderpriority" not in plan
