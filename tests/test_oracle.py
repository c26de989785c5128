"""Every query against its SQL."""

import pytest

from tests.compare import of_duck, of_spark
from tests.conftest import DATA
from tidemark.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    names, rows = of_spark(QUERIES[name](spark, DATA))
    if name not in ORACLE:
        assert rows
        return
    expected, right = of_duck(duck, ORACLE[name])
    assert names == expected
    assert rows == right


def test_only_outlines_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"flood_polygons"}  # its outlines are tested in test_outlines.py


def test_flagship_shuffles_twice(spark):
    """Dry and wet observations once each: merging by date and month reuses the partitioning by pixel."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["monthly_flood_days"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Python" not in plan and "Pandas" not in plan
