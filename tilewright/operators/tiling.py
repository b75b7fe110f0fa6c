"""Placement of features on tiles and time buckets, and the index over them.

Each is one projection and at most one partial-final aggregation: rows are
shuffled only as partial sums by tile and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import space, timing



def place(features: DataFrame, zoom: int, width_ms: int | None = None) -> DataFrame:
    """Adds ``zoom, x, y`` and ``bucket_ms``; features without a place go."""
    lon, lat = F.col("lon"), F.col("lat")
    out = features.where(space.valid(lon, lat)).withColumns({"zoom": F.lit(zoom), "x": space.tile_x(lon, zoom), "y": space.tile_y(lat, zoom)})
    return out.withColumn("bucket_ms", timing.bucket(F.col("start_ms"), width_ms)) if width_ms else out


def pyramid(features: DataFrame, low: int, high: int, width_ms: int | None = None) -> DataFrame:
    """Every feature at every zoom. The tile at the highest zoom is computed once; coarser ones are its shifted bits."""
    deep = place(features, high, width_ms).drop("zoom").withColumnRenamed("x", "_x").withColumnRenamed("y", "_y")
    out = deep.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return out.withColumns({"x": F.expr(f"shiftright(_x, {high} - zoom)"), "y": F.expr(f"shiftright(_y, {high} - zoom)")}).drop("_x", "_y")


def tile_counts(features: DataFrame, low: int, high: int) -> DataFrame:
    """Features by tile for a range of zooms: grouped once at the deepest zoom, then the counts are rolled up."""
    deep = place(features, high).groupBy("x", "y").agg(F.count("*").alias("n")).withColumnsRenamed({"x": "_x", "y": "_y"})
    each = deep.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return each.groupBy("zoom", F.expr(f"shiftright(_x, {high} - zoom)").alias("x"), F.expr(f"shiftright(_y, {high} - zoom)").alias("y")).agg(F.sum("n").alias("n"))


def index(placed: DataFrame, keys: tuple[str, ...] = ("zoom", "x", "y", "bucket_ms")) -> DataFrame:
    """Count and tight covering times of every tile."""
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("start_ms").alias("cover_t_min"), F.max("end_ms").alias("time_end"))


def min_features(tiles: DataFrame, least: int) -> DataFrame:
    return tiles.where(F.col("n") >= least)


def zoom_band(placed: DataFrame, low: str, high: str) -> DataFrame:
    """Rows whose zoom is within their own band; a missing end is open."""
    z = F.col("zoom")
    return placed.where((z >= F.coalesce(F.col(low), F.lit(0))) & (z <= F.coalesce(F.col(high), F.lit(99))))


def check_tiers(base_ms: int, tiers: list[tuple[int, int]]) -> None:
    """Tiers (width, highest zoom) widen in order, each a multiple of the one before."""
    before = base_ms
    for width, _ in tiers:
        if width <= before or width % before:
            raise ValueError(f"bucket {width} does not extend {before}")
        before = width


def temporal_tiers(features: DataFrame, zoom: int, base_ms: int, tiers: list[tuple[int, int]]) -> DataFrame:
    """The base index and one re-bucketed index for each tier that serves this zoom, from the base's sums."""
    check_tiers(base_ms, tiers)
    base = index(place(features, zoom, base_ms)).withColumn("width_ms", F.lit(base_ms).cast("long"))
    out = base
    for width, highest in tiers:
        if zoom <= highest:
            wide = base.groupBy("zoom", "x", "y", timing.bucket(F.col("bucket_ms"), width).alias("bucket_ms")).agg(F.sum("n").alias("n"), F.min("cover_t_min").alias("cover_t_min"), F.max("time_end").alias("time_end"))
            out = out.unionByName(wide.withColumn("width_ms", F.lit(width).cast("long")))
    return out


def pick_tier(zoom: int, base_ms: int, tiers: list[tuple[int, int]]) -> int:
    """The coarsest width that serves the zoom."""
    return max([base_ms, *(w for w, highest in tiers if zoom <= highest)])


def prune_time(tiles: DataFrame, low: int, high: int) -> DataFrame:
    """Tiles whose covering interval meets a window; compares plain columns, so file statistics prune."""
    return tiles.where((F.col("time_end") >= low) & (F.coalesce(F.col("cover_t_min"), F.col("bucket_ms")) <= high))


def prune_box(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Tiles that meet a box (west, south, east, north), as bounds on x and y for each zoom."""
    west, south, east, north = map(F.lit, box)
    z = F.col("zoom")
    return tiles.where((F.col("x") >= space.tile_x(west, z)) & (F.col("x") <= space.tile_x(east, z)) & (F.col("y") >= space.tile_y(north, z)) & (F.col("y") <= space.tile_y(south, z)))


def serve(features: DataFrame, zoom: int, x: int, y: int, bucket_ms: int, width_ms: int, pad: float = 0.05, least_pad: float = 0.001) -> DataFrame:
    """One tile's features, from a padded box and a half-open window that push down, then placed exactly."""
    n = 1 << zoom
    if not (0 <= x < n and 0 <= y < n):
        raise ValueError(f"no tile {zoom}/{x}/{y}")
    import math

    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    west, east, south, north = x / n * 360 - 180, (x + 1) / n * 360 - 180, lat(y + 1), lat(y)
    px, py = max((east - west) * pad, least_pad), max((north - south) * pad, least_pad)
    near = features.where((F.col("lon") >= west - px) & (F.col("lon") <= east + px) & (F.col("lat") >= south - py) & (F.col("lat") <= north + py) & (F.col("start_ms") >= bucket_ms) & (F.col("start_ms") < bucket_ms + width_ms))
    return place(near, zoom, width_ms).where((F.col("x") == x) & (F.col("y") == y) & (F.col("bucket_ms") == bucket_ms))


def home_zoom(features: DataFrame, low: int, high: int, width_ms: int, spacing_px: float = 0.4, id_col: str = "feature_id", importance: str | None = None) -> DataFrame:
    """Adds ``home_zoom``: from coarse to fine, the most important unclaimed feature of each voxel of space and time
    claims it; the rest, and all that cannot be placed, go to the highest zoom. One window per zoom over what is left."""
    from pyspark.sql import Window

    order = [F.col(importance).desc()] if importance else []
    features = features.withColumn("home_zoom", F.lit(None).cast("int"))
    placeable = F.coalesce(space.valid(F.col("lon"), F.col("lat")), F.lit(False)) & F.col("start_ms").isNotNull()
    left, done = features.where(placeable), features.where(~placeable).withColumn("home_zoom", F.lit(high))
    for z in range(low, high):
        pitch = F.lit(spacing_px * space.EARTH_M_PER_PIXEL / 2**z / 111320.0)
        keys = [F.floor((F.col("lon") + 180) / pitch), F.floor((F.col("lat") + 90) / pitch), timing.bucket(F.col("start_ms"), width_ms)]
        ranked = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.col(id_col))))
        won = ranked.where("_n = 1").drop("_n").withColumn("home_zoom", F.lit(z))
        done = done.unionByName(won)
        left = ranked.where("_n > 1").drop("_n")
    return done.unionByName(left.withColumn("home_zoom", F.lit(high)))


def count_cap(placed: DataFrame, most: int, score: str, id_col: str = "feature_id", keys: tuple[str, ...] = ("zoom", "x", "y")) -> DataFrame:
    """The highest scores of each tile, with ``n_dropped`` of it. Rank filters push into the window as a group limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = placed.withColumn("_n", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(id_col)))).withColumn("_all", F.count("*").over(w))
    return ranked.where(F.col("_n") <= most).withColumn("n_dropped", F.greatest(F.col("_all") - most, F.lit(0))).drop("_n", "_all")
