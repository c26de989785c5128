"""Every operator as a query over the test tables, with SQL for the same result where SQL can say it.

Doubles are rounded to six places, lists are joined to text; both engines then agree to the letter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import MONTH_NODATA
from tidemark.functions import classes as cl
from tidemark.functions import geo, radiometry, text
from tidemark.operators import baseline as base
from tidemark.operators import blocks, catalog, duration, merge, neighbourhood, regrid, summaries, tiles, vectorise
from tidemark.operators.detect import Otsu, ZScore, otsu_thresholds
from tidemark.plans import views
from tidemark.plans.oracle import PX, low, using
from tidemark.sources.store import shared_folder
from tidemark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
LOOSE = -1.5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def s6(e: str) -> str:
    return f"(round({e}, 6) + 0.0::DOUBLE)"


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(spark, sf)


def dry(spark: SparkSession, sf: str) -> DataFrame:
    return views.in_months(obs(spark, sf), views.DRY)


def wet(spark: SparkSession, sf: str) -> DataFrame:
    return views.in_months(obs(spark, sf), views.WET)


def classified(spark: SparkSession, sf: str, threshold: float = LOOSE) -> DataFrame:
    return ZScore(threshold, threshold).detect(wet(spark, sf), base.fit(dry(spark, sf))).drop("vv", "vh")


def dates(spark: SparkSession, sf: str, threshold: float = LOOSE) -> DataFrame:
    return merge.by_date(classified(spark, sf, threshold))


def months(spark: SparkSession, sf: str, threshold: float = LOOSE) -> DataFrame:
    return merge.by_month(dates(spark, sf, threshold))


def slopes(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.slope(views.view(spark, sf, views.DEM))


def years(spark: SparkSession, sf: str) -> DataFrame:
    """The largest class of each pixel and year, as scenes named by the year."""
    d = dates(spark, sf).groupBy("aoi_id", F.date_format("obs_date", "yyyy").alias("scene_id"), "px_row", "px_col")
    return d.agg(F.max("cls").alias("cls"))


def monthly_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).groupBy("aoi_id", text.month_tag(F.col("obs_date")).alias("scene_id"), "px_row", "px_col").agg(F.max("vv").alias("vv"), F.max("vh").alias("vh"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.AREAS)


def newest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.newest(views.view(spark, sf, views.CATALOG))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.match(areas(spark, sf), newest(spark, sf))


# Pixels: map algebra, baseline, classes.


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN " + s6("10 * log10(l_discount)") + " END AS db, " + s6("pow(10.0::DOUBLE, -l_quantity / 10)") + " AS linear, CASE WHEN l_quantity < 17 THEN l_quantity END AS masked, l_discount > 0 AND l_quantity < 17 AS both_valid FROM lineitem")
def decibels(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    q = radiometry.below_nodata(F.col("l_quantity"))
    db = radiometry.linear_to_decibel(F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", r6(db).alias("db"), r6(radiometry.decibel_to_linear(-F.col("l_quantity"))).alias("linear"), q.alias("masked"), radiometry.both_valid(db, q).alias("both_valid"))


@query(using(f"SELECT {PX}, {s6('vv_mean')} AS vv_mean, {s6('vv_std')} AS vv_std, n_vv, {s6('vh_mean')} AS vh_mean, {s6('vh_std')} AS vh_std, n_vh FROM base", "base"))
def dry_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return base.fit(dry(spark, sf)).select(*base.PIXEL, *[x for b in base.BANDS for x in (r6(f"{b}_mean").alias(f"{b}_mean"), r6(f"{b}_std").alias(f"{b}_std"), f"n_{b}")])


@query(ORACLE["dry_baseline"])
def dry_baseline_folded(spark: SparkSession, sf: str) -> DataFrame:
    """The same from moments of April and of May, merged."""
    d = dry(spark, sf)
    out = base.fold([d.filter(F.month("obs_date") == m) for m in views.DRY])
    return out.select(*base.PIXEL, *[x for b in base.BANDS for x in (r6(f"{b}_mean").alias(f"{b}_mean"), r6(f"{b}_std").alias(f"{b}_std"), f"n_{b}")])


@query(using("SELECT * FROM classes", "classes"))
def zscore_classes(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf)


@query(using("SELECT aoi_id, scene_id, obs_date, px_row, px_col, 2 * coalesce({}, false)::INT + coalesce({}, false)::INT AS cls FROM wet LEFT JOIN base USING ({})".format(low("vv", LOOSE), low("vh", LOOSE), PX), "wet", "base"))
def zscore_classes_without_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return ZScore(LOOSE, LOOSE, gap_aware=False).detect(wet(spark, sf), base.fit(dry(spark, sf))).drop("vv", "vh")


@query(using(f"SELECT {PX}, {s6('slope_deg')} AS slope_deg FROM slope", "slope"))
def terrain_slope(spark: SparkSession, sf: str) -> DataFrame:
    return slopes(spark, sf).select(*base.PIXEL, r6("slope_deg").alias("slope_deg"))


@query(using("SELECT * FROM masked", "masked"))
def slope_masked_classes(spark: SparkSession, sf: str) -> DataFrame:
    return merge.mask_slopes(classified(spark, sf), slopes(spark, sf), 15.0)


@query(using("SELECT * FROM dates", "dates"))
def flood_dates(spark: SparkSession, sf: str) -> DataFrame:
    return dates(spark, sf)


@query(using("SELECT * FROM months", "months"))
def monthly_flood_days(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf)


TAGS = [f"{y}{m:02d}" for y in range(1992, 2000) for m in views.WET]


@query(using(f"SELECT {PX}, {', '.join(f'max(flood_days) FILTER (ym = {t!r}) AS m{t}' for t in TAGS)} FROM months GROUP BY {PX}", "months"))
def monthly_flood_days_wide(spark: SparkSession, sf: str) -> DataFrame:
    return merge.months_wide(months(spark, sf), TAGS)


@query(using("SELECT * FROM valid", "valid"))
def valid_scene_count(spark: SparkSession, sf: str) -> DataFrame:
    return merge.valid_scenes(wet(spark, sf))


@query(using(f"SELECT {PX}, days::BIGINT AS days, n_valid, {s6('days / nullif(n_valid, 0)::DOUBLE')} AS fraction FROM (SELECT {PX}, sum(CASE WHEN flood_days <> 255 THEN flood_days END) AS days FROM months GROUP BY {PX}) LEFT JOIN valid USING ({PX})", "months", "valid"))
def fraction_flooded(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fraction_flooded(months(spark, sf), merge.valid_scenes(wet(spark, sf))).withColumn("fraction", r6("fraction"))


_RUNS = f"""SELECT {PX}, max(run)::BIGINT AS max_run, count(*) FILTER (run > 0) AS n_events FROM (SELECT {PX}, island, sum(wet) AS run FROM
(SELECT *, sum(1 - wet) OVER (PARTITION BY {PX} ORDER BY obs_date) AS island FROM (SELECT {PX}, obs_date, coalesce(COND, false)::INT AS wet FROM dates)) GROUP BY {PX}, island) GROUP BY {PX}"""


@query(using(_RUNS.replace("COND", "cls = 3"), "dates"))
def flood_duration(spark: SparkSession, sf: str) -> DataFrame:
    return duration.flood_runs(dates(spark, sf))


@query(using(_RUNS.replace("COND", "cls > 0"), "dates"))
def flood_duration_any_class(spark: SparkSession, sf: str) -> DataFrame:
    return duration.flood_runs(dates(spark, sf), cl.any_class)


@query(using("SELECT *, CASE WHEN flood_days = 255 THEN NULL WHEN flood_days = 0 THEN 0 WHEN flood_days <= 3 THEN 1 WHEN flood_days <= 7 THEN 2 ELSE 3 END AS bin FROM months", "months"))
def flood_days_bins(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf).withColumn("bin", cl.flood_days_bin(F.col("flood_days")))


@query(using("SELECT aoi_id, CASE WHEN cls = 3 THEN 'high confidence' WHEN cls > 0 THEN 'low confidence' WHEN cls = 0 THEN 'not flooded' END AS confidence, count(*) AS n FROM dates GROUP BY ALL", "dates"))
def flood_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return dates(spark, sf).groupBy("aoi_id", cl.confidence(F.col("cls")).alias("confidence")).agg(F.count("*").alias("n"))


@query(using("SELECT aoi_id, scene_id, count(*) FILTER (cls = 3) AS n_flooded, count(cls) AS n_valid FROM classes GROUP BY aoi_id, scene_id", "classes"))
def flooded_pixels_by_scene(spark: SparkSession, sf: str) -> DataFrame:
    return merge.flooded_pixels(classified(spark, sf))


@query(using(f"SELECT {PX}, max(cls) AS cls FROM dates GROUP BY {PX}", "dates"))
def season_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return merge.season_max(dates(spark, sf))


@query(using(f"SELECT {PX}, count(*) FILTER (cls = 3) AS n_dates FROM dates GROUP BY {PX}", "dates"))
def flooded_date_count(spark: SparkSession, sf: str) -> DataFrame:
    return merge.flooded_dates(dates(spark, sf))


@query(using(f"SELECT aoi_id, year, count(*) FILTER (hit) AS n_pixels, {s6('count(*) FILTER (hit) * 0.0009::DOUBLE')} AS area_km2 FROM (SELECT {PX}, ym[1:4] AS year, bool_or(flood_days BETWEEN 1 AND 254) AS hit FROM months GROUP BY {PX}, ym[1:4]) GROUP BY aoi_id, year", "months"))
def flooded_area_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.area_by_year(months(spark, sf)).withColumn("area_km2", r6("area_km2"))


@query(using(f"SELECT {PX}, ym[1:4] AS year, sum(CASE WHEN flood_days <> 255 THEN flood_days END)::BIGINT AS flood_days FROM months GROUP BY {PX}, ym[1:4]", "months"))
def flood_days_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.year_totals(months(spark, sf))


@query(using(f"SELECT aoi_id, ym, n_pixels, flood_days::BIGINT AS flood_days, level::BIGINT AS level, {s6('n_pixels * 0.0009::DOUBLE')} AS area_km2 FROM (SELECT aoi_id, ym, count(*) FILTER (flood_days BETWEEN 1 AND 254) AS n_pixels, sum(CASE WHEN flood_days BETWEEN 1 AND 254 THEN flood_days ELSE 0 END) AS flood_days, grouping(aoi_id, ym) AS level FROM months GROUP BY ROLLUP (aoi_id, ym))", "months"))
def flooded_area_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.area_rollup(months(spark, sf)).withColumn("area_km2", r6("area_km2"))


@query(using(f"""SELECT ym, count(d) AS n_both, count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS n_either, {s6('count(*) FILTER (d = 0) * 100.0::DOUBLE / nullif(count(d), 0)')} AS exact_pct,
{s6('count(*) FILTER (abs(d) <= 1) * 100.0::DOUBLE / nullif(count(d), 0)')} AS within_one_pct, {s6('avg(d)')} AS mean_diff, {s6('stddev_pop(d)')} AS std_diff FROM
(SELECT ym, a, b, (a - b)::DOUBLE AS d FROM (SELECT {PX}, ym, CASE WHEN flood_days <> 255 THEN flood_days END AS a FROM months) FULL JOIN (SELECT {PX}, ym, CASE WHEN flood_days <> 255 THEN flood_days END AS b FROM strict_months) USING ({PX}, ym)) GROUP BY ym""", "months", "strict_months"))
def product_agreement(spark: SparkSession, sf: str) -> DataFrame:
    out = summaries.agreement(months(spark, sf), months(spark, sf, -2.5))
    return out.select("ym", "n_both", "n_either", *[r6(c).alias(c) for c in ("exact_pct", "within_one_pct", "mean_diff", "std_diff")])


@query(using("SELECT DISTINCT ym FROM months WHERE ym IN (SELECT ym FROM strict_months WHERE flood_days BETWEEN 1 AND 254)", "months", "strict_months"))
def common_months(spark: SparkSession, sf: str) -> DataFrame:
    other = months(spark, sf, -2.5).filter(F.col("flood_days").between(1, MONTH_NODATA - 1))
    return months(spark, sf).select("ym").intersect(other.select("ym"))


_COLOUR = "(CASE WHEN {0}_h > {0}_l THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({0} - {0}_l) / ({0}_h - {0}_l))) ELSE 0.0::DOUBLE END)"


@query(using(f"""SELECT {PX}, scene_id, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN ' + s6(_COLOUR.format(c)) + f' END AS {c}' for c in ('red', 'green', 'blue'))} FROM
(SELECT *, vv AS red, vh AS green, vv - vh AS blue FROM monthly_scenes) JOIN (SELECT aoi_id, scene_id, {', '.join(f'coalesce(quantile_cont({e}, {q}), {d}) AS {c}_{k}' for c, e in (('red', 'vv'), ('green', 'vh'), ('blue', 'vv - vh')) for k, q, d in (('l', 0.02, 0), ('h', 0.98, 1)))} FROM monthly_scenes GROUP BY aoi_id, scene_id) USING (aoi_id, scene_id)""", "monthly_scenes"))
def colour_composite(spark: SparkSession, sf: str) -> DataFrame:
    c = summaries.composite(monthly_scenes(spark, sf), ["aoi_id", "scene_id"], exact=True)
    return c.select(*base.PIXEL, "scene_id", *[r6(k).alias(k) for k in ("red", "green", "blue")])


@query(using(f"""SELECT {PX}, {s6(_COLOUR.format('x'))} AS ratio FROM (SELECT {PX}, CASE WHEN vh_mean = 0 THEN 0 ELSE vv_mean / vh_mean END AS x, aoi_id FROM base) JOIN
(SELECT aoi_id, quantile_cont(x, 0.02) AS x_l, quantile_cont(x, 0.98) AS x_h FROM (SELECT aoi_id, CASE WHEN vh_mean = 0 THEN 0 ELSE vv_mean / vh_mean END AS x FROM base) GROUP BY aoi_id) USING (aoi_id) WHERE x IS NOT NULL""", "base"))
def band_ratio_stretch(spark: SparkSession, sf: str) -> DataFrame:
    b = base.fit(dry(spark, sf)).withColumn("x", radiometry.ratio(F.col("vv_mean"), F.col("vh_mean"))).filter("x is not null")
    j = b.join(summaries.clip_limits(b, ["x"], ["aoi_id"], exact=True), "aoi_id")
    return j.select(*base.PIXEL, r6(radiometry.stretched(F.col("x"), F.col("x_low"), F.col("x_high"))).alias("ratio"))


@query(using("SELECT aoi_id, obs_date, n_flooded FROM (SELECT aoi_id, obs_date, count(*) FILTER (cls = 3) AS n_flooded FROM dates GROUP BY aoi_id, obs_date) QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY n_flooded DESC, obs_date) = 1", "dates"))
def peak_flood_date(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.peak_date(dates(spark, sf))


# Otsu detector.


def _otsu_sql(band: str) -> str:
    """Columns n, two, cut of one band: histograms as rows, sums by self-join."""
    return f"""{band}_s AS (SELECT aoi_id, scene_id, {band} AS x, min({band}) OVER w AS lo, max({band}) OVER w AS hi FROM monthly_scenes WINDOW w AS (PARTITION BY aoi_id, scene_id)),
{band}_f AS (SELECT aoi_id, scene_id, least(floor((x - lo) / (hi - lo) * 256), 255)::INT AS b, count(*) AS n FROM {band}_s WHERE x IS NOT NULL AND hi > lo GROUP BY ALL),
{band}_d AS (SELECT k.aoi_id, k.scene_id, i AS b, coalesce(n, 0) AS n FROM (SELECT DISTINCT aoi_id, scene_id FROM {band}_f) k CROSS JOIN range(256) t(i) LEFT JOIN {band}_f f ON f.aoi_id = k.aoi_id AND f.scene_id = k.scene_id AND f.b = i),
{band}_c AS (SELECT aoi_id, scene_id, b, sum(n) OVER w AS w0, sum(n * b) OVER w AS m0, sum(n) OVER p AS w, sum(n * b) OVER p AS m FROM {band}_d WINDOW w AS (PARTITION BY aoi_id, scene_id ORDER BY b), p AS (PARTITION BY aoi_id, scene_id)),
{band}_v AS (SELECT aoi_id, scene_id, b, CASE WHEN w0 > 0 AND w > w0 THEN w0::DOUBLE * (w - w0)::DOUBLE * (m0::DOUBLE / w0::DOUBLE - (m - m0)::DOUBLE / (w - w0)::DOUBLE) * (m0::DOUBLE / w0::DOUBLE - (m - m0)::DOUBLE / (w - w0)::DOUBLE) ELSE -1 END AS v FROM {band}_c),
{band}_a AS (SELECT aoi_id, scene_id, b AS best FROM {band}_v QUALIFY row_number() OVER (PARTITION BY aoi_id, scene_id ORDER BY v DESC, b) = 1),
{band}_g AS (SELECT aoi_id, scene_id, least(floor((x - lo) / (hi - lo) * 32), 31)::INT AS b, count(*) AS n FROM {band}_s WHERE x IS NOT NULL AND hi > lo GROUP BY ALL),
{band}_h AS (SELECT k.aoi_id, k.scene_id, i AS b, (SELECT sum(coalesce(g.n, 0)) FROM range(-2, 3) o(d) LEFT JOIN {band}_g g ON g.aoi_id = k.aoi_id AND g.scene_id = k.scene_id AND g.b = greatest(0, least(31, i + d))) AS s FROM (SELECT DISTINCT aoi_id, scene_id FROM {band}_g) k CROSS JOIN range(32) t(i)),
{band}_k AS (SELECT aoi_id, scene_id, count(*) FILTER (s > before AND s > after AND s * 20 >= top) >= 2 AS two FROM (SELECT *, coalesce(lag(s) OVER w, 0) AS before, coalesce(lead(s) OVER w, 0) AS after, max(s) OVER (PARTITION BY aoi_id, scene_id) AS top FROM {band}_h WINDOW w AS (PARTITION BY aoi_id, scene_id ORDER BY b)) GROUP BY aoi_id, scene_id),
{band}_t AS (SELECT aoi_id, scene_id, count(x) AS n, coalesce(any_value(two), false) AS bimodal, CASE WHEN count(x) >= 100 AND any_value(two) AND any_value(lo) < any_value(lo) + (any_value(best) + 0.5) * ((any_value(hi) - any_value(lo)) / 256) THEN any_value(lo) + (any_value(best) + 0.5) * ((any_value(hi) - any_value(lo)) / 256) END AS cut FROM {band}_s LEFT JOIN {band}_a USING (aoi_id, scene_id) LEFT JOIN {band}_k USING (aoi_id, scene_id) GROUP BY aoi_id, scene_id)"""


_OTSU = f"otsu AS (SELECT * FROM (WITH {_otsu_sql('vv')}, {_otsu_sql('vh')} SELECT v.aoi_id, v.scene_id, v.n AS vv_n, v.bimodal AS vv_bimodal, v.cut AS vv_threshold, h.n AS vh_n, h.bimodal AS vh_bimodal, h.cut AS vh_threshold FROM vv_t v JOIN vh_t h ON v.aoi_id = h.aoi_id AND v.scene_id = h.scene_id))"


@query(using(f"SELECT * REPLACE ({s6('vv_threshold')} AS vv_threshold, {s6('vh_threshold')} AS vh_threshold) FROM otsu", "monthly_scenes", recursive=_OTSU))
def otsu_scene_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    t = otsu_thresholds(monthly_scenes(spark, sf))
    return t.withColumns({c: r6(c) for c in ("vv_threshold", "vh_threshold")})


@query(using(f"SELECT {PX}, scene_id, 2 * CASE WHEN vv IS NOT NULL THEN coalesce(vv < vv_threshold, false)::INT END + CASE WHEN vh IS NOT NULL THEN coalesce(vh < vh_threshold, false)::INT END AS cls FROM monthly_scenes JOIN otsu USING (aoi_id, scene_id)", "monthly_scenes", recursive=_OTSU))
def otsu_classes(spark: SparkSession, sf: str) -> DataFrame:
    return Otsu().detect(monthly_scenes(spark, sf)).select(*base.PIXEL, "scene_id", "cls")


# Neighbourhoods, grids and mosaics.


def _vote_sql(half: int) -> str:
    votes = ", ".join(f"count(*) FILTER (n.cls = {c}) AS v{c}" for c in range(4))
    pick = " ".join(f"WHEN v{c} = greatest(v0, v1, v2, v3) THEN {c}" for c in range(4))
    return f"""SELECT aoi_id, scene_id, px_row, px_col, CASE WHEN greatest(v0, v1, v2, v3) = 0 THEN NULL {pick} END AS cls FROM (SELECT y.aoi_id, y.scene_id, y.px_row, y.px_col, {votes} FROM years y JOIN years n
ON n.aoi_id = y.aoi_id AND n.scene_id = y.scene_id AND n.px_row BETWEEN y.px_row - {half} AND y.px_row + {half} AND n.px_col BETWEEN y.px_col - {half} AND y.px_col + {half} GROUP BY y.aoi_id, y.scene_id, y.px_row, y.px_col)"""


@query(using(_vote_sql(1), "years"))
def majority_filter(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.majority(years(spark, sf), 3)


@query(using(_vote_sql(2), "years"))
def majority_filter_wide(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.majority(years(spark, sf), 5)


@query(using(f"SELECT aoi_id, scene_id, px_row // 4 AS px_row, px_col // 4 AS px_col, {s6('avg(vv)')} AS vv, {s6('avg(vh)')} AS vh FROM monthly_scenes GROUP BY aoi_id, scene_id, px_row // 4, px_col // 4", "monthly_scenes"))
def block_means(spark: SparkSession, sf: str) -> DataFrame:
    out = neighbourhood.block_mean(monthly_scenes(spark, sf), 4, ["vv", "vh"], ["aoi_id", "scene_id"])
    return out.withColumns({c: r6(c) for c in ("vv", "vh")})


@query(using(f"SELECT aoi_id, scene_id, px_row // 3 AS px_row, px_col // 3 AS px_col, {s6('vv')} AS vv, {s6('vh')} AS vh FROM monthly_scenes WHERE px_row % 3 = 0 AND px_col % 3 = 0", "monthly_scenes"))
def thinned_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.thinned(monthly_scenes(spark, sf), 3).select("aoi_id", "scene_id", "px_row", "px_col", r6("vv").alias("vv"), r6("vh").alias("vh"))


@query(using(f"SELECT aoi_id, scene_id, px_row, px_col, {s6('vv::FLOAT::DOUBLE')} AS vv, {s6('vh::FLOAT::DOUBLE')} AS vh FROM monthly_scenes", "monthly_scenes"))
def block_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels to blocks of 8 x 8 and back."""
    b = blocks.to_blocks(monthly_scenes(spark, sf), ["aoi_id", "scene_id"], ["vv", "vh"], 8)
    return blocks.from_blocks(b, ["aoi_id", "scene_id"], ["vv", "vh"], 8).withColumns({c: r6(c) for c in ("vv", "vh")})


_BOX_UTM = ", ".join(f"{f}({', '.join(f'{c}{k}' for k in range(4))}) {sign} 5000::DOUBLE AS {name}" for name, f, c, sign in (("x0", "least", "e", "-"), ("y0", "least", "n", "-"), ("x1", "greatest", "e", "+"), ("y1", "greatest", "n", "+")))


def _window_sql() -> str:
    """Corners projected one after another."""
    source = "(SELECT p.aoi_id, p.scene_id, minx, miny, maxx, maxy, CASE WHEN arrival % 3 = 0 THEN NULL ELSE 43 + arrival % 2 END AS zone FROM pairs p JOIN areas USING (aoi_id) JOIN (SELECT scene_id, arrival FROM newest) USING (scene_id))"
    for k, (x, y) in enumerate((("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))):
        steps = geo.utm_forward(x, y, "coalesce(zone, 1)", "false", f"e{k}", f"n{k}")
        source = f"(SELECT * EXCLUDE (_dl, _t, _xi, _eta) FROM {geo.nested(source, steps)})"
    return f"SELECT aoi_id, scene_id, {', '.join(f'CASE WHEN zone IS NOT NULL THEN round({k}, 3) END AS {k}' for k in ('x0', 'y0', 'x1', 'y1'))} FROM (SELECT *, {_BOX_UTM} FROM {source})"


@query(using(_window_sql(), "pairs", "newest", "areas"))
def read_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the areas in scenes of zone 43 or 44; a third of the scenes have no known projection."""
    n = newest(spark, sf).withColumn("epsg", F.when(F.col("arrival") % 3 == 0, None).otherwise(32643 + F.col("arrival") % 2).cast("int"))
    w = catalog.read_windows(pairs(spark, sf), areas(spark, sf), n)
    return w.select("aoi_id", "scene_id", *[F.round(k, 3).alias(k) for k in ("x0", "y0", "x1", "y1")])


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """A 12 x 12 grid per area, laid askew over the 16 x 16 source pixels."""
    tile = obs(spark, sf).groupBy("aoi_id").agg(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(360.0).alias("xmax"), F.lit(360.0).alias("ymax"))
    return regrid.lattice(tile, 30.0)


_TARGET = "target AS (SELECT aoi_id, r::INT AS px_row, c::INT AS px_col, least(15.0::DOUBLE, c * 1.37::DOUBLE - 0.6) AS fx0, r * 1.21::DOUBLE + 0.3 AS fy FROM (SELECT DISTINCT aoi_id FROM obs) CROSS JOIN range(12) a(r) CROSS JOIN range(12) b(c)), t AS (SELECT aoi_id, px_row, px_col, greatest(0.0::DOUBLE, fx0) AS fx, fy FROM target)"


@query(using(f"""SELECT scene_id, aoi_id, px_row, px_col, CASE WHEN round(sum(w) FILTER (vv IS NOT NULL), 9) = 1 THEN {s6('sum(vv * w) / sum(w)')} END AS vv, CASE WHEN round(sum(w) FILTER (vh IS NOT NULL), 9) = 1 THEN {s6('sum(vh * w) / sum(w)')} END AS vh FROM
(SELECT aoi_id, px_row, px_col, least(15, floor(fy)::INT + dy) AS sr, least(15, floor(fx)::INT + dx) AS sc, (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM t CROSS JOIN range(2) y(dy) CROSS JOIN range(2) x(dx)) q
JOIN (SELECT aoi_id AS a, scene_id, px_row AS r, px_col AS c, vv, vh FROM monthly_scenes) s ON a = aoi_id AND r = sr AND c = sc WHERE w > 0 GROUP BY scene_id, aoi_id, px_row, px_col""", "obs", "monthly_scenes", recursive=_TARGET))
def regrid_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    w = regrid.weights(_targets(spark, sf), F.col("px_col") * 1.37 - 0.6, F.col("px_row") * 1.21 + 0.3, 16, 16)
    source = monthly_scenes(spark, sf).withColumnsRenamed({"px_row": "src_row", "px_col": "src_col"})
    out = regrid.regrid(source, w, lattice=("aoi_id", "src_row", "src_col"))
    return out.select("scene_id", *base.PIXEL, r6("vv").alias("vv"), r6("vh").alias("vh"))


#: A grid in zone 45 over a source in zone 46: the source's upper left corner, and metres of a source cell.
_AT_X, _AT_Y, _CELL = 700_000.0, 2_766_000.0, 25.0
_CORNER = geo.evaluate(geo.utm_inverse("x", "y", "zone", "south"), 45, False, x=np.array([_AT_X]), y=np.array([_AT_Y]))
_CORNER = geo.evaluate(geo.utm_forward("lon", "lat", "zone", "south"), 46, False, lon=_CORNER["lon"], lat=_CORNER["lat"])
_X0, _Y0 = float(np.floor(_CORNER["easting"][0])) - 40.0, float(np.floor(_CORNER["northing"][0])) + 30.0
_LONLAT = geo.nested(f"(SELECT aoi_id, r::INT AS px_row, c::INT AS px_col, {_AT_X}::DOUBLE + c * 30.0::DOUBLE AS x, {_AT_Y}::DOUBLE - r * 30.0::DOUBLE AS y FROM (SELECT DISTINCT aoi_id FROM obs) CROSS JOIN range(12) a(r) CROSS JOIN range(12) b(c))", geo.utm_inverse("x", "y", "45", "false"))
_PLACED = geo.nested(f"(SELECT aoi_id, px_row, px_col, lon, lat FROM {_LONLAT})", geo.utm_forward("lon", "lat", "46", "false"))
_PROJECTED = f"t AS (SELECT aoi_id, px_row, px_col, greatest(0.0::DOUBLE, least(15.0::DOUBLE, (easting - {_X0}::DOUBLE) / {_CELL}::DOUBLE - 0.5)) AS fx, greatest(0.0::DOUBLE, least(15.0::DOUBLE, ({_Y0}::DOUBLE - northing) / {_CELL}::DOUBLE - 0.5)) AS fy FROM {_PLACED})"


@query(ORACLE["regrid_bilinear"].replace(_TARGET, _PROJECTED))
def regrid_across_zones(spark: SparkSession, sf: str) -> DataFrame:
    """A grid in one zone on a source in the next: inverse and forward projection of every pixel, then the join."""
    p = _targets(spark, sf).withColumns({"x": F.col("px_col") * 30.0 + _AT_X, "y": F.lit(_AT_Y) - F.col("px_row") * 30.0})
    p = geo.apply(geo.apply(p, geo.utm_inverse("x", "y", "45", "false")), geo.utm_forward("lon", "lat", "46", "false"))
    w = regrid.weights(p, (F.col("easting") - _X0) / _CELL - 0.5, (F.lit(_Y0) - F.col("northing")) / _CELL - 0.5, 16, 16)
    source = monthly_scenes(spark, sf).withColumnsRenamed({"px_row": "src_row", "px_col": "src_col"})
    out = regrid.regrid(source, w, lattice=("aoi_id", "src_row", "src_col"))
    return out.select("scene_id", *base.PIXEL, r6("vv").alias("vv"), r6("vh").alias("vh"))


@query(using(f"SELECT scene_id, aoi_id, t.px_row, t.px_col, {s6('vv')} AS vv, {s6('vh')} AS vh FROM t JOIN (SELECT aoi_id AS a, scene_id, px_row AS r, px_col AS c, vv, vh FROM monthly_scenes) s ON a = aoi_id AND r = floor(fy + 0.5)::INT AND c = floor(fx + 0.5)::INT", "obs", "monthly_scenes", recursive=_TARGET))
def regrid_nearest(spark: SparkSession, sf: str) -> DataFrame:
    w = regrid.weights(_targets(spark, sf), F.col("px_col") * 1.37 - 0.6, F.col("px_row") * 1.21 + 0.3, 16, 16, "nearest")
    source = monthly_scenes(spark, sf).withColumnsRenamed({"px_row": "src_row", "px_col": "src_col"})
    return source.join(w, ["aoi_id", "src_row", "src_col"]).select("scene_id", *base.PIXEL, r6("vv").alias("vv"), r6("vh").alias("vh"))


@query(using(f"SELECT {PX}, {s6("arg_max(vv, {'s': scene_id, 'v': vv})")} AS vv FROM obs WHERE vv IS NOT NULL GROUP BY {PX}", "obs"))
def burst_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """The value of the last burst in order of id that has one; of the same burst, the larger."""
    o = obs(spark, sf).withColumn("ord", F.struct("scene_id", "vv"))
    return regrid.mosaic(o, list(base.PIXEL), "vv", "ord").withColumn("vv", r6("vv"))


@query(using("SELECT px_row, px_col, arg_min(elev, aoi_id) AS elev FROM dem GROUP BY px_row, px_col", "dem"))
def terrain_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.mosaic(views.view(spark, sf, views.DEM), ["px_row", "px_col"], "elev", "aoi_id", last=False)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly classes with a position: tiles in a row along 25.2 N."""
    return years(spark, sf).withColumns({"lon": F.lit(84.0) + F.col("aoi_id") * 0.012 + F.col("px_col") * 0.001, "lat": F.lit(25.2) - F.col("px_row") * 0.001})


_WORLD = "w AS (SELECT scene_id, aoi_id, cls, floor(mx / 300::DOUBLE)::BIGINT AS world_col, floor(my * -1.0::DOUBLE / 300::DOUBLE)::BIGINT AS world_row FROM " + geo.nested("(SELECT *, 84.0::DOUBLE + aoi_id * 0.012::DOUBLE + px_col * 0.001::DOUBLE AS lon, 25.2::DOUBLE - px_row * 0.001::DOUBLE AS lat FROM years)", geo.mollweide_forward("lon", "lat")) + ")"


@query(using("SELECT scene_id, world_row, world_col, max_by(cls, aoi_id * 10 + cls) AS cls FROM w WHERE cls IS NOT NULL GROUP BY scene_id, world_row, world_col", "years", recursive=_WORLD))
def state_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.world_cells(_placed(spark, sf), 300.0, ["scene_id"], "cls")


@query(using(f"SELECT scene_id, world_row, world_col, {s6('avg(cls)')} AS cls FROM w GROUP BY scene_id, world_row, world_col", "years", recursive=_WORLD))
def areal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.world_cells(_placed(spark, sf), 300.0, ["scene_id"], "cls", how="mean").withColumn("cls", r6("cls"))


def _regions_sql(source: str, key: str) -> str:
    return f"""cell AS (SELECT aoi_id, {key}, px_row AS r, px_col AS c FROM ({source})),
reach(aoi_id, {key}, r, c, r0, c0) AS (SELECT aoi_id, {key}, r, c, r, c FROM cell UNION SELECT n.aoi_id, n.{key}, n.r, n.c, p.r0, p.c0 FROM reach p JOIN cell n ON n.aoi_id = p.aoi_id AND n.{key} = p.{key} AND abs(n.r - p.r) + abs(n.c - p.c) = 1),
labelled AS (SELECT aoi_id, {key}, r, c, min(r0 * 10000 + c0) AS label FROM reach GROUP BY ALL)"""


_REGION = "SELECT aoi_id, {0}, row_number() OVER (PARTITION BY aoi_id, {0} ORDER BY label)::INT AS poly_id, count(*) AS n_cells, count(*) * 900.0::DOUBLE AS area_m2, min(r) AS min_row, min(c) AS min_col, max(r) AS max_row, max(c) AS max_col FROM labelled GROUP BY aoi_id, {0}, label"


@query(using(_REGION.format("scene_id"), "years", recursive=_regions_sql("SELECT * FROM years WHERE cls = 3", "scene_id")))
def flood_regions(spark: SparkSession, sf: str) -> DataFrame:
    return vectorise.regions(years(spark, sf), outline=False)


@query()
def flood_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return vectorise.regions(years(spark, sf))


@query(using(_REGION.format("obs_date"), "classes", recursive=_regions_sql("SELECT DISTINCT aoi_id, obs_date, px_row, px_col FROM classes WHERE cls = 3", "obs_date")))
def flood_regions_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return vectorise.dissolved(classified(spark, sf), outline=False)


# Geography.


_POINT = "(SELECT o_orderkey, (o_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, (o_orderkey * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat FROM orders)"
_ZONED = f"(SELECT *, floor((lon + 180) / 6)::INT + 1 AS utm_zone, lat < 0 AS south FROM {_POINT})"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders")
    p = o.select("o_orderkey", (F.expr("o_custkey * 7919 % 36000") / 100.0 - 180).alias("lon"), (F.expr("o_orderkey * 104729 % 16000") / 100.0 - 80).alias("lat"))
    return p.withColumns({"utm_zone": geo.utm_zone(F.col("lon")), "south": F.col("lat") < 0})


@query(f"SELECT o_orderkey, utm_zone::VARCHAR || band AS zone, CASE WHEN band >= 'N' THEN 32600 ELSE 32700 END + utm_zone AS epsg FROM (SELECT *, 'CDEFGHJKLMNPQRSTUVWX'[least(floor((lat + 80) / 8)::INT, 19) + 1] AS band FROM {_ZONED})")
def zones(spark: SparkSession, sf: str) -> DataFrame:
    z = _points(spark, sf).select("o_orderkey", geo.zone_name(F.col("lon"), F.col("lat")).alias("zone"))
    return z.withColumn("epsg", geo.zone_to_epsg(F.col("zone")))


_UTM = geo.nested(_ZONED, geo.utm_forward("lon", "lat", "utm_zone", "south"))


@query(f"SELECT o_orderkey, round(easting, 3) AS easting, round(northing, 3) AS northing FROM {_UTM}")
def utm_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    p = geo.apply(_points(spark, sf), geo.utm_forward("lon", "lat", "utm_zone", "south"))
    return p.select("o_orderkey", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query(f"SELECT o_orderkey, round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat FROM {_POINT}")
def utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """There and back gives the point again."""
    p = geo.apply(_points(spark, sf), geo.utm_forward("lon", "lat", "utm_zone", "south")).drop("lon", "lat")
    p = geo.apply(p, geo.utm_inverse("easting", "northing", "utm_zone", "south"))
    return p.select("o_orderkey", (F.round("lon", 7) + 0.0).alias("lon"), (F.round("lat", 7) + 0.0).alias("lat"))


@query(f"""SELECT o_orderkey, utm_zone::VARCHAR || 'CDEFGHJKLMNPQRSTUVWX'[least(floor((lat + 80) / 8)::INT, 19) + 1] || (['STUVWXYZ', 'ABCDEFGH', 'JKLMNPQR'])[utm_zone % 3 + 1][floor(easting / 100000)::INT]
|| (['FGHJKLMNPQRSTUVABCDE', 'ABCDEFGHJKLMNPQRSTUV'])[utm_zone % 2 + 1][floor(northing / 100000)::BIGINT % 20 + 1] AS square FROM {_UTM}""")
def square_names(spark: SparkSession, sf: str) -> DataFrame:
    p = geo.apply(_points(spark, sf), geo.utm_forward("lon", "lat", "utm_zone", "south"))
    return p.select("o_orderkey", geo.square_name(F.col("utm_zone"), geo.latitude_band(F.col("lat")), F.col("easting"), F.col("northing")).alias("square"))


def _tiles_sql(top_west: str, side: float, columns: str) -> str:
    """Squares that meet a quadrilateral: the box around all areas, or what a line from its south-west corner to its north-east leaves of it, cut by zones.

    A square is apart from a convex shape if their boxes are, or if all its corners lie outside one side."""
    box = "(SELECT min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) AS y1 FROM areas)"
    cut = f"(SELECT z::INT AS utm_zone, y0, y1, x0, x1, greatest(x0, 6.0::DOUBLE * z - 186) AS w, least(x1, 6.0::DOUBLE * z - 180) AS e FROM {box}, range(1, 61) t(z) WHERE 6 * z - 186 <= x1 AND 6 * z - 180 >= x0 AND floor((x1 + 180) / 6) + 1 >= z)"
    top = lambda x: f"CASE WHEN {top_west} THEN y1 ELSE y0 + ({x} - x0) * (y1 - y0) / (x1 - x0) END"
    corners = f"(SELECT utm_zone, unnest([0, 1, 2, 3]) AS k, unnest([w, e, e, w]) AS lon, unnest([y0, y0, {top('e')}, {top('w')}]) AS lat FROM {cut} WHERE w < e)"
    points = f"(SELECT utm_zone, list(easting ORDER BY k) AS px, list(northing ORDER BY k) AS py FROM {geo.nested(corners, geo.utm_forward('lon', 'lat', 'utm_zone', 'false'))} GROUP BY utm_zone)"
    span = lambda p: f"unnest(range(floor(list_min({p}) / {side})::BIGINT, greatest(ceil(list_max({p}) / {side})::BIGINT, floor(list_min({p}) / {side})::BIGINT + 1)))"
    rows = f"(SELECT *, {span('py')} AS j FROM (SELECT *, {span('px')} AS i FROM {points}))"
    square = f"(SELECT *, i * {side}::DOUBLE AS xmin, j * {side}::DOUBLE AS ymin, i * {side}::DOUBLE + {side}::DOUBLE AS xmax, j * {side}::DOUBLE + {side}::DOUBLE AS ymax, i * {side}::DOUBLE + {side / 2}::DOUBLE AS cx, j * {side}::DOUBLE + {side / 2}::DOUBLE AS cy FROM {rows})"
    beyond = lambda k: " AND ".join(f"(px[{k % 4 + 1}] - px[{k}]) * ({y} - py[{k}]) - (py[{k % 4 + 1}] - py[{k}]) * ({x} - px[{k}]) < 0" for x in ("xmin", "xmax") for y in ("ymin", "ymax"))
    met = f"(SELECT * FROM {square} WHERE " + " AND ".join(f"NOT ({beyond(k)})" for k in (1, 2, 3, 4)) + ")"
    named = geo.nested(met, geo.utm_inverse("cx", "cy", "utm_zone", "false", "clon", "clat"))
    band = "'CDEFGHJKLMNPQRSTUVWX'[least(floor((clat + 80) / 8)::INT, 19) + 1]"
    mgrs = f"utm_zone::VARCHAR || {band} || (['STUVWXYZ', 'ABCDEFGH', 'JKLMNPQR'])[utm_zone % 3 + 1][floor(cx / 100000)::INT] || (['FGHJKLMNPQRSTUVABCDE', 'ABCDEFGHJKLMNPQRSTUV'])[utm_zone % 2 + 1][floor(cy / 100000)::BIGINT % 20 + 1]"
    return using(f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY utm_zone, xmin, ymin) AS aoi_id, utm_zone::VARCHAR || {band} AS zone, 32600 + utm_zone AS epsg, {mgrs} AS mgrs_tile, 'REQUIRED' AS dry_month FROM {named})", "areas")


@query(_tiles_sql("true", 100_000.0, "aoi_id, zone, epsg, xmin, ymin, mgrs_tile, dry_month"))
def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """100 km tiles over the box around all areas."""
    b = catalog.union_box(areas(spark, sf)).first()
    t = tiles.generate(spark, tuple(float(b[k]) for k in catalog.BOX))
    return t.select("aoi_id", "zone", "epsg", "xmin", "ymin", "mgrs_tile", "dry_month")


@query(_tiles_sql("false", 25_000.0, "aoi_id, zone, epsg, xmin, ymin, xmax, ymax"))
def tile_fishnet(spark: SparkSession, sf: str) -> DataFrame:
    b = catalog.union_box(areas(spark, sf)).first()
    ring = [(b["minx"], b["miny"]), (b["maxx"], b["miny"]), (b["maxx"], b["maxy"])]
    return tiles.generate(spark, ring, "utm_fishnet", 25).select("aoi_id", "zone", "epsg", "xmin", "ymin", "xmax", "ymax")


_TRIANGLE = [(78.0, 18.0), (88.0, 20.0), (81.0, 27.0)]


def _in_ring_sql(x: str, y: str) -> str:
    pts = [*_TRIANGLE, _TRIANGLE[0]]
    return "(" + " + ".join(f"((({ay}::DOUBLE > {y}) <> ({by}::DOUBLE > {y})) AND {x} < ({bx - ax}::DOUBLE) * ({y} - {ay}::DOUBLE) / {by - ay}::DOUBLE + {ax}::DOUBLE)::INT" for (ax, ay), (bx, by) in zip(pts, pts[1:])) + ") % 2 = 1"


@query(using(f"SELECT scene_id, count(*) AS n FROM newest WHERE {_in_ring_sql('(minx + maxx) / 2', '(miny + maxy) / 2')} GROUP BY scene_id", "newest"))
def centres_in_boundary(spark: SparkSession, sf: str) -> DataFrame:
    n = newest(spark, sf)
    hit = geo.inside((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, geo.ring_literal(_TRIANGLE))
    return n.filter(hit).groupBy("scene_id").agg(F.count("*").alias("n"))


# Catalog.


@query("SELECT o_orderkey, (o_orderdate::DATE)::VARCHAR AS first, (o_orderdate::DATE + (o_orderkey % 30)::INT)::VARCHAR AS last, last_day(o_orderdate::DATE)::VARCHAR AS month_end FROM orders")
def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").withColumn("s", F.date_format("o_orderdate", "dd/MM/yyyy"))
    d = text.date_range(F.col("s"), F.col("o_orderkey") % 30)
    m = text.month_range(F.date_format("o_orderdate", "yyyy/MM"), F.date_format("o_orderdate", "yyyy/MM"))
    return o.select("o_orderkey", d["first"].cast("string").alias("first"), d["last"].cast("string").alias("last"), m["last"].cast("string").alias("month_end"))


@query(using("SELECT y AS year, make_date(y, a, 1) AS first, last_day(make_date(y, b, 1)) AS last FROM (SELECT min(m) AS a, max(m) AS b FROM (SELECT unnest(string_split(dry_month, ','))::INT AS m FROM areas WHERE dry_month <> 'REQUIRED')) CROSS JOIN (SELECT i::INT AS y FROM range(2015, 2021) t(i))", "areas"))
def dry_season_windows(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.dry_window(areas(spark, sf), text.contiguous_years([2015, 2017, 2020]))


@query(using(r"SELECT arrival, regexp_extract(scene_id, '(?:^|_)([0-9]{8})', 1) AS day, regexp_replace(scene_id || '.a/b', '[^A-Za-z0-9_-]', '_', 'g') AS name, split_part(scene_id, '_', 4) AS burst FROM catalog", "catalog"))
def scene_id_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = views.view(spark, sf, views.CATALOG)
    return c.select("arrival", text.date_token(F.col("scene_id")).alias("day"), text.file_name(F.concat("scene_id", F.lit(".a/b"))).alias("name"), text.id_part(F.col("scene_id"), 3).alias("burst"))


@query(using("SELECT arrival, scene_id FROM catalog WHERE collection = 'rtc' AND minx <= 84 AND maxx >= 80 AND miny <= 23 AND maxy >= 19 AND acquired >= DATE '1994-01-01' AND acquired < DATE '1996-07-01' AND has_vh", "catalog"))
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(views.scene_catalog(spark, sf), "rtc", (80, 19, 84, 23), "1994-01-01", "1996-06-30").select("arrival", "scene_id")


@query(using("SELECT arrival, scene_id FROM catalog WHERE collection = 'archive' AND minx <= 84.02 AND maxx >= 79.98 AND miny <= 23.02 AND maxy >= 18.98", "catalog"))
def terrain_search(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.base import SceneCatalog

    source = SceneCatalog(views.scene_catalog(spark, sf))
    source.dem_collection, source.dem_asset = "archive", "vv"
    return source.search_dem((80, 19, 84, 23)).select("arrival", "scene_id")


@query(using("SELECT scene_id, arrival FROM newest", "newest"))
def newest_granules(spark: SparkSession, sf: str) -> DataFrame:
    return newest(spark, sf).select("scene_id", "arrival")


@query(using("SELECT 'OPERA_PASS_' || taken[1:8] AS scene_id, taken[1:8] AS acq, string_agg(scene_id, ',' ORDER BY scene_id) AS bursts, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM newest GROUP BY taken[1:8]", "newest"))
def passes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.passes(newest(spark, sf)).withColumn("bursts", F.array_join("bursts", ","))


@query(using("SELECT * FROM pairs", "pairs"))
def area_scene_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


@query(using("SELECT aoi_id, coalesce(string_agg(scene_id, ',' ORDER BY scene_id), '') AS scenes FROM areas LEFT JOIN pairs USING (aoi_id) GROUP BY aoi_id", "areas", "pairs"))
def scenes_of_areas(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scenes_of_areas(areas(spark, sf), pairs(spark, sf)).withColumn("scenes", F.array_join("scenes", ","))


@query(using("SELECT scene_id, string_agg(aoi_id, ',' ORDER BY aoi_id) AS areas FROM pairs GROUP BY scene_id", "pairs"))
def areas_of_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.areas_of_scenes(pairs(spark, sf)).withColumn("areas", F.array_join(F.transform("areas", lambda a: a.cast("string")), ","))


@query(using("SELECT aoi_id FROM areas WHERE aoi_id NOT IN (SELECT aoi_id FROM base)", "areas", "base"))
def pending_areas(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pending(areas(spark, sf), base.fit(dry(spark, sf))).select("aoi_id")


_CACHED = "cached AS (SELECT * FROM pairs WHERE length(scene_id) + aoi_id % 3 <> substr(scene_id, 20, 1)::INT + length(scene_id) AND aoi_id % 2 = 1)"


def _cached(p: DataFrame) -> DataFrame:
    return p.filter((F.col("aoi_id") % 3 != F.substring("scene_id", 20, 1).cast("int")) & (F.col("aoi_id") % 2 == 1))


@query(using("SELECT scene_id, count(*) AS n_areas, count(c.aoi_id) AS n_cached, count(*) > count(c.aoi_id) AS must_read FROM pairs p LEFT JOIN cached c USING (aoi_id, scene_id) GROUP BY scene_id", "pairs", recursive=_CACHED))
def cache_split(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return catalog.split_by_cache(p, _cached(p))


@query(using("SELECT aoi_id, count(c.scene_id) AS n_found, count(*) - count(c.scene_id) AS n_missing FROM pairs p LEFT JOIN (SELECT aoi_id, scene_id FROM cached) c USING (aoi_id, scene_id) GROUP BY aoi_id", "pairs", recursive=_CACHED))
def scene_files_found(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return catalog.found_and_missing(p, _cached(p))


@query(using("SELECT aoi_id, scene_id FROM pairs WHERE aoi_id <= 10 UNION ALL SELECT aoi_id, scene_id FROM cached WHERE aoi_id > 10", "pairs", recursive=_CACHED))
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Cached pairs, in which newly searched areas replace their own."""
    p = pairs(spark, sf)
    return catalog.merge_pairs(_cached(p).unionByName(_cached(p).filter("aoi_id <= 10")), p.filter("aoi_id <= 10"))


@query(using("SELECT scene_id, string_agg(DISTINCT aoi_id, ',' ORDER BY aoi_id) AS areas FROM (SELECT * FROM cached UNION ALL SELECT * FROM pairs WHERE aoi_id <= 10) GROUP BY scene_id", "pairs", recursive=_CACHED))
def cache_list_union(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    out = catalog.merge_lists(catalog.areas_of_scenes(_cached(p)), catalog.areas_of_scenes(p.filter("aoi_id <= 10")), "scene_id", "areas")
    return out.withColumn("areas", F.array_join(F.transform("areas", lambda a: a.cast("string")), ","))


@query(using("SELECT aoi_id, scene_id, row_number() OVER (PARTITION BY aoi_id ORDER BY regexp_extract(scene_id, '(?:^|_)([0-9]{8})', 1), scene_id) AS place FROM pairs QUALIFY place <= 5", "pairs"))
def earliest_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.earliest(pairs(spark, sf), 5).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_custkey % 25 AS aoi_id, arg_max(path, strftime(o_orderdate, '%Y%m%d') || path) AS path FROM (SELECT *, 'tile_' || o_custkey % 25 || '/' || o_orderkey || '.tif' AS path FROM orders) GROUP BY ALL")
def newest_tile_files(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").withColumn("aoi_id", F.col("o_custkey") % 25)
    return catalog.newest_files(o.select("aoi_id", F.concat(F.lit("tile_"), "aoi_id", F.lit("/"), "o_orderkey", F.lit(".tif")).alias("path"), F.col("o_orderdate").alias("modified")))


_ZONE_OF_AREA = "areas2 AS (SELECT *, floor(((minx + maxx) / 2 + 180) / 6)::INT + 1 AS number FROM areas)"


@query(using("SELECT number::VARCHAR || 'CDEFGHJKLMNPQRSTUVWX'[floor(((miny + maxy) / 2 + 80) / 8)::INT + 1] AS zone, string_agg(aoi_id, ',' ORDER BY aoi_id) AS ids, arg_min(dry_month, aoi_id) AS dry_month FROM areas2 GROUP BY 1", "areas", recursive=_ZONE_OF_AREA))
def areas_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    a = areas(spark, sf).withColumn("zone", geo.zone_name((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2))
    return catalog.first_months(a).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(using("SELECT 1 AS aoi_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM areas", "areas"))
def union_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.union_box(areas(spark, sf))


@query(using("SELECT scene_id, minx, miny, maxx, maxy FROM newest", "newest"))
def scene_footprints(spark: SparkSession, sf: str) -> DataFrame:
    n = newest(spark, sf)
    return catalog.footprints(n.select("scene_id", geo.box_ring(*map(F.col, catalog.BOX)).alias("ring")))


# Streams, run over all that is there.


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, of: tuple) -> DataFrame:
    schema = views.table(spark, sf, of[0]).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/{of[0]}.parque[t]")
    return raw.select(*[F.expr(views.text(e, True)).alias(c) for c, e in of[1]])


@query(ORACLE["dry_baseline"])
def stream_baseline(spark: SparkSession, sf: str) -> DataFrame:
    folder = _scratch(spark)
    d = views.in_months(_stream(spark, sf, views.OBS), views.DRY)
    incremental.run_to_end(d, incremental.fold_into(folder, spark), f"{folder}/checkpoint")
    last = max(int(p.getPath().getName().split("-")[1]) for p in _list(spark, folder) if p.getPath().getName().startswith("state-"))
    out = base.finish(spark.read.parquet(f"{folder}/state-{last}"))
    return out.select(*base.PIXEL, *[x for b in base.BANDS for x in (r6(f"{b}_mean").alias(f"{b}_mean"), r6(f"{b}_std").alias(f"{b}_std"), f"n_{b}")])


def _list(spark: SparkSession, folder: str) -> list:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return list(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def _kept(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    folder = _scratch(spark)
    incremental.run_to_end(stream, incremental.store_into(f"{folder}/out", mode), f"{folder}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


@query(ORACLE["zscore_classes"])
def stream_classes(spark: SparkSession, sf: str) -> DataFrame:
    w = views.in_months(_stream(spark, sf, views.OBS), views.WET)
    return _kept(spark, incremental.classify(w, ZScore(LOOSE, LOOSE), base.fit(dry(spark, sf))).drop("vv", "vh"))


@query(using("SELECT * FROM dates WHERE obs_date + 8 <= (SELECT max(obs_date) FROM classes)", "dates", "classes"))
def stream_flood_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that a watermark of seven days has closed."""
    w = views.in_months(_stream(spark, sf, views.OBS), views.WET)
    c = incremental.classify(w, ZScore(LOOSE, LOOSE), base.fit(dry(spark, sf)))
    return _kept(spark, incremental.daily(c, "7 days"))


@query(using("SELECT burst, taken, arg_max(scene_id, processed) AS scene_id FROM items GROUP BY burst, taken", "items"))
def stream_newest_granules(spark: SparkSession, sf: str) -> DataFrame:
    c = incremental.newest_granules(_stream(spark, sf, views.CATALOG))
    return _kept(spark, c, "complete")


@query(f"SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, {s6('sum(value)')} AS total FROM events GROUP BY event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 25 HOURS <= (SELECT max(ts) FROM events)")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    out = _kept(spark, incremental.event_counts(e))
    return out.withColumns({"total": r6("total"), "start": F.col("start").cast("timestamp_ntz")})
