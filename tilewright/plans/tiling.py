"""Queries on tiles, buckets and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import space, timing
from tilewright.operators import cells, tiling
from tilewright.plans.base import DAY, HOUR, POINTS, T0, Catalogue, placed_sql, x_sql, y_sql
from tilewright.sources import features as src

C = Catalogue()


@C.add("tile_counts_z6", f"WITH {placed_sql(6)} SELECT zoom, x, y, count(*) AS n FROM placed GROUP BY ALL")
def tile_counts_z6(spark, d):
    return tiling.tile_counts(src.points(spark, d), 6, 6)


@C.add("tile_pyramid_z0_8", f"WITH {POINTS} SELECT z AS zoom, {x_sql('z')} AS x, {y_sql('z')} AS y, count(*) AS n FROM pts, range(0, 9) t(z) GROUP BY ALL")
def tile_pyramid(spark, d):
    return tiling.tile_counts(src.points(spark, d), 0, 8)


@C.add("bucket_hourly", f"WITH {POINTS} SELECT start_ms - start_ms % {HOUR} AS bucket_ms, count(*) AS n, round(sum(value), 4) AS total FROM pts GROUP BY ALL")
def bucket_hourly(spark, d):
    return src.points(spark, d).groupBy(timing.bucket(F.col("start_ms"), HOUR).alias("bucket_ms")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_INDEX = "count(*) AS n, min(start_ms) AS cover_t_min, max(end_ms) AS time_end"


@C.add("tile_bucket_index", f"WITH {placed_sql(6, HOUR)} SELECT zoom, x, y, bucket_ms, {_INDEX} FROM placed GROUP BY ALL")
def tile_bucket_index(spark, d):
    return tiling.index(tiling.place(src.points(spark, d), 6, HOUR))


@C.add(
    "tile_bounds",
    f"""WITH {placed_sql(5)}, t AS (SELECT DISTINCT zoom, x, y FROM placed)
    SELECT zoom, x, y, round(x / 32 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32)))), 6) AS south,
           round((x + 1) / 32 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 32)))), 6) AS north FROM t""",
)
def tile_bounds(spark, d):
    t = tiling.place(src.points(spark, d), 5).select("zoom", "x", "y").distinct()
    return t.select("*", *[F.round(v, 6).alias(k) for k, v in space.tile_bounds(F.col("x"), F.col("y"), 5).items()])


@C.add("tile_parent_rollup", f"WITH {placed_sql(7)}, t AS (SELECT x, y, count(*) AS n FROM placed GROUP BY ALL) SELECT 6 AS zoom, x >> 1 AS x, y >> 1 AS y, sum(n)::BIGINT AS n, count(*) AS children FROM t GROUP BY x >> 1, y >> 1")
def tile_parent_rollup(spark, d):
    t = tiling.tile_counts(src.points(spark, d), 7, 7)
    return t.groupBy(F.lit(6).alias("zoom"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.sum("n").alias("n"), F.count("*").alias("children"))


_BANDS = "CASE r_name WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 END AS min_zoom, CASE r_name WHEN 'AFRICA' THEN 5 WHEN 'ASIA' THEN 6 END AS max_zoom"


@C.add(
    "zoom_band_filter",
    f"""WITH {POINTS}, b AS (SELECT p.*, {_BANDS} FROM pts p JOIN region ON r_regionkey = p.user_id % 5)
    SELECT z AS zoom, count(*) AS n, count(DISTINCT user_id) AS users FROM b, range(0, 9) t(z) WHERE z >= coalesce(min_zoom, 0) AND z <= coalesce(max_zoom, 99) GROUP BY ALL""",
)
def zoom_band_filter(spark, d):
    region = src.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.expr(_BANDS.split(", CASE")[0]), F.expr("CASE" + _BANDS.split(", CASE")[1]))
    p = src.points(spark, d).withColumn("k", F.pmod("user_id", F.lit(5))).join(F.broadcast(region), "k")  # five rows
    return tiling.zoom_band(p.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(8)))), "min_zoom", "max_zoom").groupBy("zoom").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@C.add("min_features_gate", f"WITH {placed_sql(5, DAY)} SELECT zoom, x, y, bucket_ms, {_INDEX} FROM placed GROUP BY ALL HAVING count(*) >= 3")
def min_features_gate(spark, d):
    return tiling.min_features(tiling.index(tiling.place(src.points(spark, d), 5, DAY)), 3)


_TIERS = [(6 * HOUR, 5), (24 * HOUR, 4)]


@C.add(
    "temporal_lod_union",
    f"WITH {placed_sql(4)} "
    + " UNION ALL ".join(f"SELECT zoom, x, y, start_ms - start_ms % {w} AS bucket_ms, {_INDEX}, {w}::BIGINT AS width_ms FROM placed GROUP BY zoom, x, y, start_ms - start_ms % {w}" for w in (HOUR, 6 * HOUR, 24 * HOUR)),
)
def temporal_lod_union(spark, d):
    return tiling.temporal_tiers(src.points(spark, d), 4, HOUR, _TIERS)


_W0, _W1 = T0 + 5 * DAY, T0 + 9 * DAY


@C.add("tile_window_prune", f"WITH {placed_sql(5, 6 * HOUR)}, t AS (SELECT zoom, x, y, bucket_ms, {_INDEX} FROM placed GROUP BY ALL) SELECT * FROM t WHERE time_end >= {_W0} AND coalesce(cover_t_min, bucket_ms) <= {_W1}")
def tile_window_prune(spark, d):
    return tiling.prune_time(tiling.index(tiling.place(src.points(spark, d), 5, 6 * HOUR)), _W0, _W1)


_BOX = (-100.0, -30.0, 20.5, 42.0)


@C.add(
    "tile_bbox_prune",
    f"""WITH {placed_sql(5, DAY)}, t AS (SELECT zoom, x, y, bucket_ms, {_INDEX} FROM placed GROUP BY ALL)
    SELECT * FROM t WHERE x BETWEEN {x_sql(5, "(-100.0::DOUBLE)")} AND {x_sql(5, "20.5::DOUBLE")} AND y BETWEEN {y_sql(5, "42.0::DOUBLE")} AND {y_sql(5, "(-30.0::DOUBLE)")}""",
)
def tile_bbox_prune(spark, d):
    return tiling.prune_box(tiling.index(tiling.place(src.points(spark, d), 5, DAY)), _BOX)


@C.add("serve_tile", f"WITH {placed_sql(3, DAY)} SELECT feature_id, lon, lat, start_ms, event_type, value, zoom, x, y, bucket_ms FROM placed WHERE x = 6 AND y = 4 AND bucket_ms = {T0 + 3 * DAY}")
def serve_tile(spark, d):
    return tiling.serve(src.points(spark, d), 3, 6, 4, T0 + 3 * DAY, DAY).select("feature_id", "lon", "lat", "start_ms", "event_type", "value", "zoom", "x", "y", "bucket_ms")


_BROKEN = "CASE WHEN feature_id % 10 = 3 THEN 181.5 WHEN feature_id % 10 = 7 THEN CAST('NaN' AS DOUBLE) WHEN feature_id % 10 = 9 THEN NULL ELSE lon END"


@C.add("invalid_coord_drop", f"WITH {POINTS}, b AS (SELECT * REPLACE ({_BROKEN} AS lon) FROM pts) SELECT {x_sql(3)} AS x, {y_sql(3)} AS y, count(*) AS n FROM b WHERE lon IS NOT NULL AND NOT isnan(lon) AND lon BETWEEN -180 AND 180 GROUP BY ALL")
def invalid_coord_drop(spark, d):
    b = src.points(spark, d).withColumn("lon", F.expr(_BROKEN))
    return tiling.place(b, 3).groupBy("x", "y").agg(F.count("*").alias("n"))


@C.add(
    "user_filter_pass_through",
    f"WITH {POINTS} SELECT feature_id, lon, lat, start_ms, end_ms, event_type, value FROM pts WHERE value > 100 AND event_type = 'click'",
)
def user_filter(spark, d):
    p = src.points(spark, d).drop("user_id")
    return src.read_features(p, "start_ms", "end_ms", ("lon", "lat"), where="value > 100 AND event_type = 'click'").select("feature_id", "lon", "lat", "start_ms", "end_ms", "event_type", "value")


_MORTON = lambda x, y, bits: " | ".join(f"(((({x}) >> {i}) & 1) << {2 * i}) | (((({y}) >> {i}) & 1) << {2 * i + 1})" for i in range(bits))


def _cell_sql(zoom: int, x: str, y: str) -> str:
    free = 52 - 2 * zoom
    return f"({space.QUADBIN_HEADER | zoom << 52 | ((1 << free) - 1)}::BIGINT | (({_MORTON(x, y, zoom)}) << {free}))"


@C.add("quadbin_encode", f"WITH {placed_sql(9)} SELECT feature_id, {_cell_sql(9, 'x', 'y')} AS cell FROM placed")
def quadbin_encode(spark, d):
    return tiling.place(src.points(spark, d), 9).select("feature_id", space.quadbin(F.col("x"), F.col("y"), 9).alias("cell"))


@C.add("quadbin_decode_centroid", f"WITH {placed_sql(9)}, t AS (SELECT DISTINCT x, y FROM placed) SELECT 9 AS zoom, x, y, round((x + 0.5) / 512 * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5) / 512)))), 6) AS lat FROM t")
def quadbin_decode(spark, d):
    t = tiling.place(src.points(spark, d), 9).select(space.quadbin(F.col("x"), F.col("y"), 9).alias("cell")).distinct()
    zoom, x, y = space.quadbin_parts(F.col("cell"))
    lon, lat = cells.centroid(F.col("cell"))
    return t.select(zoom.alias("zoom"), x.alias("x"), y.alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_CELLS = f"WITH {placed_sql(4, DAY)}, c AS (SELECT *, {_cell_sql(7, x_sql(7), y_sql(7))} AS cell FROM placed)"


@C.add("summary_quadbin", f"{_CELLS} SELECT zoom, x, y, bucket_ms, cell, count(*) AS n, round(avg(value), 6) AS mean_value FROM c GROUP BY ALL")
def summary_quadbin(spark, d):
    return cells.summary(tiling.place(src.points(spark, d), 4), 4, DAY, "count,value:mean").withColumn("mean_value", F.round("mean_value", 6))


@C.add("summary_multi_agg", f"{_CELLS} SELECT zoom, x, y, bucket_ms, cell, count(*) AS n, round(sum(value), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value FROM c GROUP BY ALL")
def summary_multi_agg(spark, d):
    return cells.summary(tiling.place(src.points(spark, d), 4), 4, DAY, "count,value:sum,value:min,value:max").withColumn("sum_value", F.round("sum_value", 4))


@C.add("summary_sub_buckets", f"{_CELLS} SELECT zoom, x, y, bucket_ms, cell, count(*) AS n, " + ", ".join(f"sum(CASE WHEN least((start_ms - bucket_ms) // {6 * HOUR}, 3) = {i} THEN 1 ELSE 0 END)::BIGINT AS bucket_{i}" for i in range(4)) + " FROM c GROUP BY ALL")
def summary_sub_buckets(spark, d):
    return cells.summary(tiling.place(src.points(spark, d), 4), 4, DAY, "count", 4)


@C.add("cell_ids_valid", f"{_CELLS} SELECT count(DISTINCT cell) AS cells, 0::BIGINT AS malformed FROM c")
def cell_ids_valid(spark, d):
    c = cells.summary(tiling.place(src.points(spark, d), 4), 4, DAY).select("cell").distinct()
    return c.agg(F.count("*").alias("cells"), F.sum(F.when(cells.is_cell(F.col("cell"), 7), 0).otherwise(1)).alias("malformed"))


@C.add(
    "home_zoom",
    f"""WITH {POINTS}, v0 AS (SELECT feature_id, row_number() OVER (PARTITION BY floor((lon + 180) / {{p0}}), floor((lat + 90) / {{p0}}), start_ms - start_ms % {DAY} ORDER BY value DESC, feature_id) AS k, lon, lat, start_ms, value FROM pts),
    v1 AS (SELECT feature_id, row_number() OVER (PARTITION BY floor((lon + 180) / {{p1}}), floor((lat + 90) / {{p1}}), start_ms - start_ms % {DAY} ORDER BY value DESC, feature_id) AS k FROM v0 WHERE k > 1)
    SELECT v0.feature_id, CASE WHEN v0.k = 1 THEN 0 WHEN v1.k = 1 THEN 1 ELSE 2 END AS home_zoom FROM v0 LEFT JOIN v1 ON v0.feature_id = v1.feature_id""".format(
        p0=repr(10 * space.EARTH_M_PER_PIXEL / 2**0 / 111320.0) + "::DOUBLE", p1=repr(10 * space.EARTH_M_PER_PIXEL / 2**1 / 111320.0) + "::DOUBLE"
    ),
)
def home_zoom(spark, d):
    return tiling.home_zoom(src.points(spark, d), 0, 2, DAY, spacing_px=10, importance="value").select("feature_id", "home_zoom")


@C.add(
    "budget_count_cap",
    f"""WITH {placed_sql(3)}, r AS (SELECT *, row_number() OVER (PARTITION BY zoom, x, y ORDER BY value DESC, feature_id) AS k, count(*) OVER (PARTITION BY zoom, x, y) AS c FROM placed)
    SELECT zoom, x, y, feature_id, value, greatest(c - 5, 0) AS n_dropped FROM r WHERE k <= 5""",
)
def budget_count_cap(spark, d):
    return tiling.count_cap(tiling.place(src.points(spark, d), 3), 5, "value").select("zoom", "x", "y", "feature_id", "value", "n_dropped")
