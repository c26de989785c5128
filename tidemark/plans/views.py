"""Rasters, terrain, areas and a scene catalog seen in the test tables, in Spark and in the oracle's SQL.

Each view is one list of (column, expression). Expressions are the same text for both engines but for whole-number
division (DIV) and dates as digits (YMD), which ``text`` puts in the engine's words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS = ("lineitem", [
    ("aoi_id", "cast(l_suppkey % 4 as int)"), ("scene_id", "concat('S1A_', YMD(l_shipdate), '_T', l_linenumber)"), ("obs_date", "cast(l_shipdate as date)"),
    ("px_row", "cast(l_partkey % 16 as int)"), ("px_col", "cast(((l_suppkey DIV 4) + l_orderkey) % 16 as int)"),
    ("vv", "case when l_discount > 0 then 10 * log10(l_extendedprice / 105000.0) end"), ("vh", "10 * log10(l_quantity / 50.0)"),
])
DEM = ("part", [
    ("aoi_id", "cast((p_partkey - 1) DIV 256 as int)"), ("px_row", "cast(((p_partkey - 1) DIV 16) % 16 as int)"), ("px_col", "cast((p_partkey - 1) % 16 as int)"), ("elev", "cast(p_size as double)"),
])
AREAS = ("nation", [
    ("aoi_id", "cast(n_nationkey + 1 as int)"), ("dry_month", "case n_regionkey when 0 then '04,05' when 1 then '05,04' when 2 then '03, 05' when 3 then '04' else 'REQUIRED' end"),
    ("minx", "cast(77.5 + 2 * (n_nationkey % 5) as double)"), ("miny", "cast(17.75 + 2 * (n_nationkey DIV 5) as double)"), ("maxx", "cast(79.0 + 2 * (n_nationkey % 5) as double)"), ("maxy", "cast(19.0 + 2 * (n_nationkey DIV 5) as double)"),
])
_BURST = "concat('OPERA_L2_RTC-S1_T', lpad(cast(o_custkey % 50 as string), 3, '0'), '-IW', o_custkey % 3 + 1, '_', YMD(o_orderdate), 'T000000Z_', lpad(cast(20300000 + o_orderkey % 9 as string), 8, '0'), 'T000000Z_S1A_30_v1.0')"
CATALOG = ("orders", [
    ("scene_id", _BURST), ("collection", "case when o_orderstatus = 'F' then 'archive' else 'rtc' end"), ("acquired", "cast(o_orderdate as timestamp)"),
    ("minx", "cast(76 + 0.2 * (o_custkey % 60) as double)"), ("miny", "cast(17 + 0.25 * (o_custkey % 47) as double)"), ("maxx", "cast(76.8 + 0.2 * (o_custkey % 60) as double)"), ("maxy", "cast(17.6 + 0.25 * (o_custkey % 47) as double)"),
    ("has_vh", "o_orderkey % 7 <> 0"), ("arrival", "o_orderkey"),
])
#: Months of the dry and of the wet season in the view of lineitem.
DRY, WET = (4, 5), (7, 8, 9, 10)


def text(sql: str, spark: bool) -> str:
    sql = sql.replace(" DIV ", " div " if spark else " // ")
    sql = re.sub(r"YMD\((\w+)\)", r"date_format(\1, 'yyyyMMdd')" if spark else r"strftime(\1, '%Y%m%d')", sql)
    return sql.replace("as timestamp)", "as timestamp_ntz)") if spark else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, of: tuple[str, list[tuple[str, str]]]) -> DataFrame:
    return table(spark, sf_dir, of[0]).select(*[F.expr(text(e, True)).alias(c) for c, e in of[1]])


def sql(of: tuple[str, list[tuple[str, str]]]) -> str:
    return f"SELECT {', '.join(f'{text(e, False)} AS {c}' for c, e in of[1])} FROM {of[0]}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBS)


def in_months(obs: DataFrame, months) -> DataFrame:
    return obs.filter(F.month("obs_date").isin(list(months)))


def scene_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with a map of assets: always VV, VH where the view has it."""
    c = view(spark, sf_dir, CATALOG)
    both = F.create_map(F.lit("vv"), F.concat("scene_id", F.lit("_VV.tif")), F.lit("vh"), F.concat("scene_id", F.lit("_VH.tif")))
    one = F.create_map(F.lit("vv"), F.concat("scene_id", F.lit("_VV.tif")))
    return c.withColumn("assets", F.when(F.col("has_vh"), both).otherwise(one)).drop("has_vh")
