"""Tile archives: features in curve order, a directory with zone maps, a manifest; pruned reads and checks.

Layout below a root: ``features/zoom=…`` (Parquet, range-partitioned and sorted
by curve key and time, so row groups have tight bounds), ``directory`` (one row
a tile), ``manifest`` (one JSON text file, written last: a root without it is
no archive).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import space, timing
from tilewright.operators import tiling

FORMAT = 1


def write(features: DataFrame, root: str, zooms: tuple[int, int], width_ms: int, tiers: list[tuple[int, int]] = (), name: str = "archive") -> dict:
    """Writes the deepest zoom's features once; coarser tiles are directory rows over the same files."""
    low, high = zooms
    tiling.check_tiers(width_ms, list(tiers))
    placed = tiling.place(features, high, width_ms)
    keyed = placed.withColumn("curve", space.hilbert(F.col("x"), F.col("y"), high))
    keyed.repartitionByRange("curve", "bucket_ms").sortWithinPartitions("curve", "bucket_ms", "start_ms").write.option("compression", "zstd").parquet(f"{root}/features")
    spark = features.sparkSession
    stored = spark.read.parquet(f"{root}/features")
    deep = stored.groupBy("x", "y", "bucket_ms").agg(F.count("*").alias("n"), F.min("start_ms").alias("cover_t_min"), F.max("end_ms").alias("time_end"))
    each = deep.withColumnsRenamed({"x": "_x", "y": "_y"}).withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = each.groupBy("zoom", F.expr(f"shiftright(_x, {high} - zoom)").alias("x"), F.expr(f"shiftright(_y, {high} - zoom)").alias("y"), "bucket_ms").agg(F.sum("n").alias("n"), F.min("cover_t_min").alias("cover_t_min"), F.max("time_end").alias("time_end"))
    up.repartitionByRange("zoom", "x", "bucket_ms").sortWithinPartitions("zoom", "x", "y", "bucket_ms").write.option("compression", "zstd").parquet(f"{root}/directory")
    e = stored.agg(F.count("*"), F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"), F.min("start_ms"), F.max("end_ms")).first()
    manifest = {"format": FORMAT, "name": name, "features": e[0], "bounds": list(e[1:5]), "time_range": list(e[5:7]), "zooms": [low, high], "bucket_ms": width_ms, "tiers": [list(t) for t in tiers]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{root}/manifest")
    return manifest


def manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/manifest").first()[0])


def directory(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/directory")


def read(spark: SparkSession, root: str, box: tuple[float, float, float, float] | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Features that meet a box and a window. Bounds are plain comparisons, so they reach the files' statistics."""
    df = spark.read.parquet(f"{root}/features")
    if box:
        west, south, east, north = box
        high = manifest(spark, root)["zooms"][1]
        a, b = F.lit(west), F.lit(east)
        df = df.where((F.col("lon") >= west) & (F.col("lon") <= east) & (F.col("lat") >= south) & (F.col("lat") <= north))
        df = df.where((F.col("x") >= space.tile_x(a, high)) & (F.col("x") <= space.tile_x(b, high)))
    if window:
        df = df.where((F.col("end_ms") >= window[0]) & (F.col("start_ms") <= window[1]))
    return df


def tile(spark: SparkSession, root: str, zoom: int, x: int, y: int, bucket_ms: int) -> DataFrame:
    """One tile's features."""
    m = manifest(spark, root)
    low, high = m["zooms"]
    if not low <= zoom <= high:
        raise ValueError(f"zoom {zoom} is not served")
    up = high - zoom
    return spark.read.parquet(f"{root}/features").where(F.col("x").between(x << up, ((x + 1) << up) - 1) & F.col("y").between(y << up, ((y + 1) << up) - 1) & (F.col("bucket_ms") == bucket_ms))


def check(spark: SparkSession, root: str) -> DataFrame:
    """``check, offenders`` for each check of an archive; a sound one has zeros."""
    from tilewright.operators import checks

    m, d = manifest(spark, root), directory(spark, root)
    f, high = spark.read.parquet(f"{root}/features"), m["zooms"][1]
    deep = d.where(F.col("zoom") == high)
    found = f.groupBy("x", "y", "bucket_ms").agg(F.max("end_ms").alias("e"), F.min("start_ms").alias("s"))
    loose = deep.join(found, ["x", "y", "bucket_ms"]).where((F.col("time_end") != F.col("e")) | (F.col("cover_t_min") != F.col("s")))
    misplaced = f.where((F.col("x") != space.tile_x(F.col("lon"), high)) | (F.col("y") != space.tile_y(F.col("lat"), high)))
    wrong_total = d.groupBy("zoom").agg(F.sum("n").alias("n")).where(F.col("n") != m["features"])
    duplicates = d.groupBy("zoom", "x", "y", "bucket_ms").count().where("count > 1")
    out_of_range = d.where((F.col("cover_t_min") < m["time_range"][0]) | (F.col("time_end") > m["time_range"][1]))
    tests = {
        "counts": checks.count_mismatches(deep, f, ["x", "y", "bucket_ms"]),
        "totals": wrong_total,
        "intervals": checks.backwards(f),
        "tight_times": loose,
        "buckets": checks.out_of_bucket(f, m["bucket_ms"]),
        "placement": misplaced,
        "bounds": checks.outside(f, tuple(m["bounds"])),
        "time_range": out_of_range,
        "unique_tiles": duplicates,
    }
    out = None
    for name, rows in tests.items():
        one = rows.agg(F.count("*").alias("offenders")).select(F.lit(name).alias("check"), "offenders")
        out = one if out is None else out.unionByName(one)
    return out


def tilejson(m: dict, url: str) -> dict:
    west, south, east, north = m["bounds"]
    return {"tilejson": "3.0.0", "name": m["name"], "tiles": [url], "minzoom": m["zooms"][0], "maxzoom": m["zooms"][1], "bounds": m["bounds"], "center": [(west + east) / 2, (south + north) / 2, m["zooms"][0]]}


def stac_item(m: dict, href: str, start: str, end: str) -> dict:
    w, s, e, n = m["bounds"]
    ring = [[w, s], [e, s], [e, n], [w, n], [w, s]]
    return {"type": "Feature", "stac_version": "1.0.0", "id": m["name"], "bbox": m["bounds"], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": None, "start_datetime": start, "end_datetime": end}, "links": [], "assets": {"data": {"href": href}}}


def aligned_range(m: dict) -> tuple[int, int]:
    return timing.align_start(m["time_range"][0], m["bucket_ms"], tuple(t[0] for t in m["tiers"])), m["time_range"][1]
