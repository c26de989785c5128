"""The catalog of scenes: search, newest version, passes, which scene serves which area, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import SCENE_MARGIN_M
from tidemark.functions import geo
from tidemark.functions.text import date_token, dry_months, id_part, season

BOX = ("minx", "miny", "maxx", "maxy")


def search(catalog: DataFrame, collection: str, box: tuple[float, float, float, float], start: str | None = None, end: str | None = None, assets=("vv", "vh")) -> DataFrame:
    """Scenes of a collection whose footprint meets the box, taken from start to end (days, both whole), with all assets.

    ``catalog``: scene_id, collection, acquired, minx..maxy, assets (map). Filters are plain comparisons, so a columnar
    scan skips what cannot match."""
    hit = (F.col("collection") == collection) & (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1])
    if start is not None:
        hit &= F.col("acquired") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        hit &= F.col("acquired") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    for a in assets:
        hit &= F.try_element_at("assets", F.lit(a)).isNotNull()
    return catalog.filter(hit)


def newest(items: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One item per granule: the greatest processing stamp, the first to arrive of equals.

    An id's parts 3 and 4 name the granule, part 5 its processing; an id of four parts or fewer is its own granule."""
    parts = F.split("scene_id", "_")
    many = F.size(parts) > 4
    key = F.struct(F.when(many, id_part(F.col("scene_id"), 3)).otherwise(F.col("scene_id")).alias("burst"), F.when(many, id_part(F.col("scene_id"), 4)).otherwise(F.lit("")).alias("taken"))
    order = Window.partitionBy("_granule").orderBy(F.coalesce(id_part(F.col("scene_id"), 5), F.lit("")).desc(), F.col(arrival))
    return items.withColumn("_granule", key).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_granule")


def passes(items: DataFrame) -> DataFrame:
    """One pass per acquisition date, whatever its track: scene_id, bursts in order of id, their common box."""
    day = F.substring(F.coalesce(id_part(F.col("scene_id"), 4), F.lit("")), 1, 8)
    grouped = items.withColumn("acq", day).groupBy("acq").agg(F.sort_array(F.collect_list("scene_id")).alias("bursts"), *[(F.min if k.startswith("min") else F.max)(k).alias(k) for k in BOX])
    return grouped.select(F.concat(F.lit("OPERA_PASS_"), "acq").alias("scene_id"), "acq", "bursts", *BOX)


def _bins(df: DataFrame, size: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / float(size)).cast("int")
    d = df.withColumn("_bx", F.explode(F.sequence(at("minx"), at("maxx"))))
    return d.withColumn("_by", F.explode(F.sequence(at("miny"), at("maxy"))))


def match(areas: DataFrame, scenes: DataFrame, bin_degrees: float = 1.0) -> DataFrame:
    """aoi_id, scene_id of areas and scenes that meet; both have minx..maxy, and are refined by ``ring`` if both have it.

    An equi-join on degree bins. A pair that shares several bins counts in the bin of its common corner only, so
    nothing has to be made distinct."""
    refine = "ring" in areas.columns and "ring" in scenes.columns
    pick = lambda df, key, p: df.select(F.col(key), *[F.col(k).alias(f"{p}{k}") for k in (*BOX, *(["ring"] if refine else []))], "_bx", "_by")
    a, s = pick(_bins(areas, bin_degrees), "aoi_id", "a_"), pick(_bins(scenes, bin_degrees), "scene_id", "s_")
    j = a.join(s, ["_bx", "_by"])
    j = j.filter((F.col("a_minx") <= F.col("s_maxx")) & (F.col("a_maxx") >= F.col("s_minx")) & (F.col("a_miny") <= F.col("s_maxy")) & (F.col("a_maxy") >= F.col("s_miny")))
    own = lambda k: F.floor(F.greatest(f"a_{k}", f"s_{k}") / float(bin_degrees)).cast("int")
    j = j.filter((F.col("_bx") == own("minx")) & (F.col("_by") == own("miny")))
    if refine:
        j = j.filter(geo.rings_meet(F.col("a_ring"), F.col("s_ring")))
    return j.select("aoi_id", "scene_id")


def scenes_of_areas(areas: DataFrame, pairs: DataFrame) -> DataFrame:
    """aoi_id, scenes (ordered ids; empty for an area without one)."""
    lists = pairs.groupBy("aoi_id").agg(F.sort_array(F.collect_list("scene_id")).alias("scenes"))
    return areas.select("aoi_id").join(lists, "aoi_id", "left").select("aoi_id", F.coalesce("scenes", F.array().cast("array<string>")).alias("scenes"))


def areas_of_scenes(pairs: DataFrame) -> DataFrame:
    """scene_id, areas (ordered ids)."""
    return pairs.groupBy("scene_id").agg(F.sort_array(F.collect_list("aoi_id")).alias("areas"))


def pending(areas: DataFrame, done: DataFrame) -> DataFrame:
    """Areas without a row in ``done``."""
    return areas.join(done.select("aoi_id").distinct(), "aoi_id", "left_anti")


def split_by_cache(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """scene_id, n_areas, n_cached, must_read: a scene is read unless every area that needs it has it cached."""
    hits = cached.select("aoi_id", "scene_id").distinct().withColumn("_hit", F.lit(1))
    j = pairs.join(hits, ["aoi_id", "scene_id"], "left")
    return j.groupBy("scene_id").agg(F.count("*").alias("n_areas"), F.count("_hit").alias("n_cached"), (F.count("*") > F.count("_hit")).alias("must_read"))


def merge_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Area-scene pairs where the areas of ``new`` replace those of ``old``."""
    kept = old.join(new.select("aoi_id").distinct(), "aoi_id", "left_anti")
    return kept.select("aoi_id", "scene_id").unionByName(new.select("aoi_id", "scene_id").distinct())


def merge_lists(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """Lists by key as the ordered union of both tables' lists."""
    j = old.select(key, F.col(items).alias("_a")).join(new.select(key, F.col(items).alias("_b")), key, "full_outer")
    empty = lambda c, o: F.coalesce(c, F.slice(o, 1, 0))
    return j.select(key, F.sort_array(F.array_union(empty("_a", "_b"), empty("_b", "_a"))).alias(items))


def found_and_missing(wanted: DataFrame, there: DataFrame, keys=("aoi_id", "scene_id")) -> DataFrame:
    """Of each area's wanted scenes, how many are there and how many are not."""
    j = wanted.join(there.select(*keys).distinct().withColumn("_hit", F.lit(1)), list(keys), "left")
    return j.groupBy("aoi_id").agg(F.count("_hit").alias("n_found"), (F.count("*") - F.count("_hit")).alias("n_missing"))


def earliest(scenes: DataFrame, n: int) -> DataFrame:
    """The n earliest scenes of each area by the date in their id; equal dates by id."""
    order = Window.partitionBy("aoi_id").orderBy("_day", "scene_id")
    d = scenes.withColumn("_day", date_token(F.col("scene_id")))
    return d.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("_day")


def newest_files(files: DataFrame) -> DataFrame:
    """aoi_id, path: of each area's files the one changed last, the greater path of equals."""
    return files.groupBy("aoi_id").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def dry_window(areas: DataFrame, years: list[int]) -> DataFrame:
    """year, first, last: from the earliest to the latest dry month over all areas, in every year.

    Areas whose season is not set are left out; without any other there is no row."""
    m = areas.filter(F.col("dry_month").rlike(r"^\s*[0-9]")).select(F.explode(dry_months(F.col("dry_month"))).alias("m"))
    ends = m.agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a is not null")
    return ends.select(F.explode(F.array(*map(F.lit, years))).alias("year"), "a", "b").select("year", season(F.col("year"), F.col("a"), F.col("b")).alias("s")).select("year", "s.first", "s.last")


def first_months(areas: DataFrame) -> DataFrame:
    """zone, ids in order, and the dry months of the area of smallest id."""
    return areas.groupBy("zone").agg(F.sort_array(F.collect_list("aoi_id")).alias("ids"), F.min_by("dry_month", "aoi_id").alias("dry_month"))


def union_box(areas: DataFrame) -> DataFrame:
    """One box around all areas, under the id 1."""
    return areas.agg(*[(F.min if k.startswith("min") else F.max)(k).alias(k) for k in BOX]).select(F.lit(1).alias("aoi_id"), *BOX)


def footprints(scenes: DataFrame) -> DataFrame:
    """scene_id and the box of its ring."""
    return scenes.select("scene_id", geo.ring_bounds(F.col("ring")).alias("b")).select("scene_id", "b.*")


def search_rings(areas: DataFrame, separate: bool = True, buffer: float = 0.0) -> DataFrame:
    """aoi_id and the closed ring of the box to search in; with ``separate`` false one ring around all, under the id 1.

    ``buffer`` metres are added in UTM, in the zone of the area of smallest id, for neighbourhoods at the edges."""
    box = areas.select("aoi_id", *BOX)
    if buffer:
        first = areas.select(F.col("aoi_id"), geo.utm_zone((F.col("minx") + F.col("maxx")) / 2).alias("_z"), ((F.col("miny") + F.col("maxy")) < 0).alias("_s"))
        first = first.agg(F.min_by("_z", "aoi_id").alias("_zone"), F.min_by("_s", "aoi_id").alias("_south"))
        box = box.crossJoin(first)  # one row
        box = _corners(box, "_zone", "_south", buffer)
        for k, x, y in ((0, "_x0", "_y0"), (1, "_x1", "_y0"), (2, "_x1", "_y1"), (3, "_x0", "_y1")):
            box = geo.apply(box, geo.utm_inverse(x, y, "_zone", "_south", f"lon{k}", f"lat{k}"))
        ends = {"minx": F.least(*[f"lon{k}" for k in range(4)]), "maxx": F.greatest(*[f"lon{k}" for k in range(4)]), "miny": F.least(*[f"lat{k}" for k in range(4)]), "maxy": F.greatest(*[f"lat{k}" for k in range(4)])}
        box = box.withColumns(ends).select("aoi_id", *BOX)
    if not separate:
        box = union_box(box)
    return box.select("aoi_id", geo.box_ring(*map(F.col, BOX)).alias("ring"))


def _corners(box: DataFrame, zone: str, south: str, margin: float) -> DataFrame:
    """Adds _x0, _y0, _x1, _y1: the box in metres of a zone, widened."""
    for k, (x, y) in enumerate((("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))):
        box = geo.apply(box, geo.utm_forward(x, y, zone, south, f"e{k}", f"n{k}"))
    ends = {"_x0": F.least(*[f"e{k}" for k in range(4)]) - margin, "_y0": F.least(*[f"n{k}" for k in range(4)]) - margin, "_x1": F.greatest(*[f"e{k}" for k in range(4)]) + margin, "_y1": F.greatest(*[f"n{k}" for k in range(4)]) + margin}
    return box.withColumns(ends).drop(*[f"{c}{k}" for c in "en" for k in range(4)])


def read_windows(pairs: DataFrame, areas: DataFrame, scenes: DataFrame, margin: float = SCENE_MARGIN_M) -> DataFrame:
    """aoi_id, scene_id and the window to read (x0, y0, x1, y1 in the scene's coordinates), widened by ``margin`` metres.

    ``scenes`` has epsg; where it is no UTM code the window is NULL and the whole scene is read."""
    j = pairs.join(areas.select("aoi_id", *BOX), "aoi_id").join(scenes.select("scene_id", "epsg"), "scene_id")
    utm = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)
    j = j.withColumns({"_zone": F.when(utm, F.col("epsg") % 100).otherwise(1).cast("int"), "_south": F.coalesce(F.col("epsg") >= 32700, F.lit(False))})
    j = _corners(j, "_zone", "_south", margin)
    return j.select("aoi_id", "scene_id", *[F.when(utm, F.col(f"_{k}")).alias(k) for k in ("x0", "y0", "x1", "y1")])
