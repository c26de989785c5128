"""Tables of a project in one folder of shared storage, and the small files around them."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.functions import geo

#: Table -> what its files are partitioned by.
LAYOUT = {
    "areas": [], "pairs": ["aoi_id"], "obs": ["aoi_id", "scene_id"], "baseline": ["tag", "aoi_id"], "dem": ["aoi_id"], "slope": ["aoi_id"],
    "classes": ["tag", "aoi_id"], "dates": ["tag", "aoi_id"], "months": ["tag", "aoi_id"], "valid": ["tag", "aoi_id"], "polygons": ["tag", "aoi_id"],
}
#: Types of partition columns, which folder names do not tell.
KINDS = {"aoi_id": IntegerType(), "scene_id": StringType(), "tag": StringType()}
#: Rows of pixels in one file.
BAND_ROWS = 1024
#: Tables that the monthly result can be made again from; ``flush`` drops the others.
RESULTS = ("areas", "baseline", "slope", "dates", "months", "valid", "polygons")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set a folder is chosen on one machine, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


class Store:
    """Parquet tables under ``root``. Writing replaces the partitions that the rows are in and no others, so a step that
    is run again, or whose executors were lost, leaves the same files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._fs(self.path(table))
        return fs.exists(p)

    def write(self, table: str, df: DataFrame, sort: tuple[str, ...] = ()) -> None:
        """``sort`` orders rows inside files, which lets scans skip row groups; a partition gets a file per band of rows."""
        keys = LAYOUT[table]
        if sort:
            df = df.repartition(*keys, F.expr(f"{sort[0]} div {BAND_ROWS}")) if keys else df
            df = df.sortWithinPartitions(*keys, *sort)
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        found = self.spark.read.parquet(self.path(table)).schema
        kinds = [StructField(f.name, KINDS[f.name]) if f.name in LAYOUT[table] else f for f in found]
        return self.spark.read.schema(StructType(kinds)).parquet(self.path(table))

    def areas_done(self, table: str, tag: str | None = None) -> list[int]:
        """Areas with a partition in the table, read from folder names."""
        fs, p = self._fs(self.path(table) + (f"/tag={tag}" if tag else ""))
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split("=", 1)[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("aoi_id="))

    def scenes_done(self) -> DataFrame:
        """aoi_id, scene_id of stored observations: a scan of partition columns only."""
        if not self.exists("obs"):
            return self.spark.createDataFrame([], "aoi_id int, scene_id string")
        return self.read("obs").select("aoi_id", "scene_id").distinct()

    def flush(self, slope: bool = False) -> list[str]:
        """Drops what results can be made without; results stay. Returns the names of the dropped tables."""
        dropped = []
        for table in LAYOUT:
            if table not in RESULTS or slope and table == "slope":
                fs, p = self._fs(self.path(table))
                if fs.exists(p):
                    fs.delete(p, True)
                    dropped.append(table)
        return dropped


BUCKETED_BY = ("aoi_id", "px_row")


def write_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """A catalog table in buckets of pixel rows. Tables with as many buckets join and aggregate by pixel without a shuffle.

    For archives that many queries go over; ``use_buckets`` lets joins on the whole pixel key take a part of it for their partitioning."""
    own = df.repartition(buckets, *BUCKETED_BY)
    own.write.mode("overwrite").bucketBy(buckets, *BUCKETED_BY).sortBy(*BUCKETED_BY, "px_col").saveAsTable(table)


def use_buckets(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def read_areas(spark: SparkSession, path: str, id_col: str = "ID", zone_col: str = "zone", dry_col: str = "dry_month") -> DataFrame:
    """Tiles from a GeoJSON feature collection: aoi_id, zone, dry_month, ring, minx..maxy. The id column may have any name."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    ring = geo.ring_of_pairs(F.get(F.col("geometry.coordinates"), F.lit(0)))
    prop = lambda c: F.try_element_at("properties", F.lit(c))
    f = f.select(prop(id_col).cast("int").alias("aoi_id"), prop(zone_col).alias("zone"), prop(dry_col).alias("dry_month"), ring.alias("ring"))
    return f.withColumn("_b", geo.ring_bounds(F.col("ring"))).select("*", "_b.*").drop("_b")


def area_features(areas: DataFrame) -> DataFrame:
    """One GeoJSON feature per line (column value), ready for ``write.text``."""
    point = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("aoi_id").alias("ID"), "zone", "dry_month").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(point).alias("coordinates")).alias("geometry"),
    )
    return areas.select(F.to_json(feature).alias("value"))


def parse_config(text: str) -> dict:
    """Settings of a run from JSON, or from YAML where its parser is installed; else from plain ``key: value`` lines with nesting by indent."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return _plain(text)


def _scalar(v: str):
    v = v.strip()
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    if v.lower() in ("", "null", "~", "none"):
        return None
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            continue
    return v


def _plain(text: str) -> dict:
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        body = bare.strip()
        if body.startswith("- ") and last:
            held = last[0][last[1]]
            last[0][last[1]] = [*(held if isinstance(held, list) else []), _scalar(body[2:])]
            continue
        key, _, value = body.partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        into = stack[-1][1]
        if value.strip():
            into[key.strip()] = _scalar(value)
        else:
            into[key.strip()] = {}
            stack.append((depth, into[key.strip()]))
        last = (into, key.strip())
    return out
