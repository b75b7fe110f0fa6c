"""Queries on geometry, layout, checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import space, timing, values
from tilewright.operators import geometry, layout, tiling
from tilewright.plans.base import DAY, HOUR, POINTS, SPANS, T0, Catalogue, placed_sql
from tilewright.sources import features as src

C = Catalogue()
_BOX = (-60.0, -20.0, 40.0, 30.0)
_BY = "OVER (PARTITION BY user_id ORDER BY start_ms, feature_id)"
_T = lambda p, q, a, b: (f"CASE WHEN {q} = {p} THEN CASE WHEN {p} BETWEEN {a} AND {b} THEN 0.0 ELSE 2.0 END ELSE least(({a} - {p}) / nullif({q} - {p}, 0), ({b} - {p}) / nullif({q} - {p}, 0)) END", f"CASE WHEN {q} = {p} THEN 1.0 ELSE greatest(({a} - {p}) / nullif({q} - {p}, 0), ({b} - {p}) / nullif({q} - {p}, 0)) END")
_TX, _TY = _T("lon", "lon1", "(-60.0::DOUBLE)", "40.0::DOUBLE"), _T("lat", "lat1", "(-20.0::DOUBLE)", "30.0::DOUBLE")


@C.add("liang_barsky_segments", f"WITH {POINTS}, n AS (SELECT *, lead(lon) {_BY} AS lon1, lead(lat) {_BY} AS lat1 FROM pts), t AS (SELECT feature_id, greatest(0.0, {_TX[0]}, {_TY[0]}) AS t0, least(1.0, {_TX[1]}, {_TY[1]}) AS t1 FROM n WHERE lon1 IS NOT NULL) SELECT feature_id, round(t0::DOUBLE, 9) AS t0, round(t1::DOUBLE, 9) AS t1 FROM t WHERE t0 <= t1")
def liang_barsky(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start_ms", "feature_id")
    n = src.points(spark, d).withColumns({"lon1": F.lead("lon").over(w), "lat1": F.lead("lat").over(w)}).where("lon1 IS NOT NULL")
    t0, t1 = geometry.clip_shares(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"), _BOX)
    return n.select("feature_id", t0.alias("t0"), t1.alias("t1")).where("t0 <= t1").withColumns({"t0": F.round("t0", 9), "t1": F.round("t1", 9)})


def _tracks(spark, d):
    return geometry.tracks(src.points(spark, d), "user_id")


@C.add("trajectory_slices")
def trajectory_slices(spark, d):
    return geometry.placed_tracks(_tracks(spark, d), "user_id", 3, 5 * DAY)


@C.add("supercover_tiles")
def supercover_tiles(spark, d):
    return geometry.track_tiles(_tracks(spark, d), "user_id", 4)


@C.add("simplify_tdtr")
def simplify_tdtr(spark, d):
    return geometry.simplified(_tracks(spark, d), "user_id", 20.0)


def _boxes(spark, d):
    c = src.points(spark, d)
    a, b = F.pmod("feature_id", F.lit(17)) * 0.5 + 0.5, F.pmod("feature_id", F.lit(11)) * 0.5 + 0.5
    lon, lat = F.col("lon"), F.col("lat")
    wrap = lambda v: F.when(v > 180, v - 360).otherwise(v)
    return c.select(F.col("feature_id").alias("id"), F.array(lon, wrap(lon + a), wrap(lon + a), lon).alias("ring_lon"), F.array(lat, lat, lat + b, lat + b).alias("ring_lat"), (a * b).alias("true_area"))


@C.add("polygon_clip")
def polygon_clip(spark, d):
    return geometry.clipped_boxes(_boxes(spark, d), 4)


@C.add("ring_area", "SELECT event_id AS id, round(((event_id % 17) * 0.5::DOUBLE + 0.5) * ((event_id % 11) * 0.5::DOUBLE + 0.5), 4) AS area FROM events")
def ring_area(spark, d):
    """Areas of all rings, those across the antimeridian unwrapped."""
    lon = geometry.unwrapped(F.col("ring_lon"))
    return _boxes(spark, d).select("id", F.round(geometry.ring_area(lon, F.col("ring_lat")), 4).alias("area"))


_M3 = " | ".join(f"(((x >> {i}) & 1) << {3 * i}) | (((y >> {i}) & 1) << {3 * i + 1}) | (((nth >> {i}) & 1) << {3 * i + 2})" for i in range(10))


def _indexed(spark, d):
    return tiling.index(tiling.place(src.points(spark, d), 5, DAY))


@C.add("morton3_key", f"WITH {placed_sql(5, DAY)}, t AS (SELECT DISTINCT x, y, bucket_ms, (bucket_ms - {T0}) // {DAY} AS nth FROM placed) SELECT x, y, bucket_ms, {_M3} AS morton3 FROM t")
def morton3_key(spark, d):
    return layout.with_keys(_indexed(spark, d), 5, T0, DAY).select("x", "y", "bucket_ms", "morton3")


@C.add(
    "hilbert2_key",
    f"""WITH RECURSIVE {placed_sql(5)}, t AS (SELECT DISTINCT x, y FROM placed), w AS (
      SELECT x AS x0, y AS y0, x, y, 4 AS k, 0::BIGINT AS h FROM t
      UNION ALL
      SELECT x0, y0,
        CASE WHEN (y >> k) & 1 = 0 THEN (CASE WHEN (x >> k) & 1 = 1 THEN 31 - y ELSE y END) ELSE x END,
        CASE WHEN (y >> k) & 1 = 0 THEN (CASE WHEN (x >> k) & 1 = 1 THEN 31 - x ELSE x END) ELSE y END,
        k - 1, h + xor(3 * ((x >> k) & 1), (y >> k) & 1) * (1 << (2 * k)) FROM w WHERE k >= 0)
    SELECT x0 AS x, y0 AS y, h AS hilbert FROM w WHERE k = -1""",
)
def hilbert2_key(spark, d):
    return tiling.place(src.points(spark, d), 5).select("x", "y").distinct().withColumn("hilbert", space.hilbert(F.col("x"), F.col("y"), 5))


@C.add("ordering_cost")
def ordering_cost(spark, d):
    return spark.createDataFrame(layout.ordering_cost(_indexed(spark, d), 5, T0, DAY))


# --- checks


@C.add("interval_sanity", f"WITH {SPANS} SELECT count(*) AS n, count(*) FILTER (raw_end < raw_start) AS backwards, min(l_orderkey) FILTER (raw_end < raw_start) AS first_offender FROM spans")
def interval_sanity(spark, d):
    bad = F.col("raw_end") < F.col("raw_start")
    return src.intervals(spark, d).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("backwards"), F.min(F.when(bad, F.col("l_orderkey"))).alias("first_offender"))


_LOOSE = "CASE WHEN (x + y) % 7 = 3 THEN 1000 ELSE 0 END"


@C.add("time_end_tight", f"WITH {placed_sql(5, DAY)}, t AS (SELECT x, y, bucket_ms, max(end_ms) AS true_end, max(end_ms) + {_LOOSE} AS time_end FROM placed GROUP BY x, y, bucket_ms) SELECT x, y, bucket_ms, time_end, true_end FROM t WHERE time_end <> true_end")
def time_end_tight(spark, d):
    declared = _indexed(spark, d).select("x", "y", "bucket_ms", (F.col("time_end") + F.expr(_LOOSE)).alias("time_end"))
    true = tiling.place(src.points(spark, d), 5, DAY).groupBy("x", "y", "bucket_ms").agg(F.max("end_ms").alias("true_end"))
    return declared.join(true, ["x", "y", "bucket_ms"]).where("time_end <> true_end")


@C.add("counts_agree", f"WITH {placed_sql(5, DAY)}, t AS (SELECT count(*) AS n FROM placed GROUP BY x, y, bucket_ms) SELECT count(*) AS tiles, sum(n)::BIGINT AS in_directory, (SELECT count(*) FROM events) AS in_source, sum(n) = (SELECT count(*) FROM events) AS agree FROM t")
def counts_agree(spark, d):
    t = _indexed(spark, d).agg(F.count("*").alias("tiles"), F.sum("n").alias("in_directory"))
    s = src.table(spark, d, "events").agg(F.count("*").alias("in_source"))
    return t.crossJoin(s).withColumn("agree", F.col("in_directory") == F.col("in_source"))  # one row each


@C.add("bounds_contain", f"WITH {POINTS}, b AS (SELECT min(lon) + 1 AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM pts) SELECT count(*) FILTER (lon < w OR lon > e OR lat < s OR lat > n) AS outside FROM pts, b")
def bounds_contain(spark, d):
    p = src.points(spark, d)
    b = p.agg((F.min("lon") + 1).alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return p.crossJoin(F.broadcast(b)).agg(F.count(F.when(F.expr("lon < w OR lon > e OR lat < s OR lat > n"), 1)).alias("outside"))  # one row


@C.add("schema_drift", "SELECT 'extra' AS column_name, 'added' AS change UNION ALL SELECT 'p_size', 'retyped' UNION ALL SELECT 'p_type', 'removed'")
def schema_drift(spark, d):
    from tilewright.operators import checks

    part = src.table(spark, d, "part")
    return checks.schema_drift(part, part.drop("p_type").withColumn("extra", F.lit(1)).withColumn("p_size", F.col("p_size").cast("string")))


# --- scalars


@C.add("iso8601_parse", "SELECT event_id, i AS shape, epoch_us(CASE i WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END) // 1000 AS ms FROM events, range(0, 4) t(i)")
def iso8601_parse(spark, d):
    e = src.table(spark, d, "events")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.'000'", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    texts = F.array(*[F.struct(F.lit(i).cast("long").alias("shape"), F.date_format(F.col("ts").cast("timestamp"), s).alias("s")) for i, s in enumerate(shapes)])
    return e.select("event_id", F.explode(texts).alias("t")).select("event_id", "t.shape", timing.parse_iso8601(F.col("t.s")).alias("ms"))


@C.add("unit_scaling", "SELECT event_id, event_id * 1000 AS from_s, event_id AS from_ms, event_id // 1000 AS from_us, (event_id * 1000003) // 1000000 AS from_ns FROM events")
def unit_scaling(spark, d):
    i = F.col("event_id")
    return src.table(spark, d, "events").select(i, timing.to_ms(i, "s").alias("from_s"), timing.to_ms(i).alias("from_ms"), timing.to_ms(i, "us").alias("from_us"), timing.to_ms(i * 1000003, "ns").alias("from_ns"))


@C.add("category_bands", "SELECT CASE WHEN value < 5 THEN 'minor' WHEN value < 20 THEN 'light' WHEN value < 60 THEN 'moderate' WHEN value < 120 THEN 'strong' ELSE 'great' END AS band, count(*) AS n FROM events GROUP BY ALL")
def category_bands(spark, d):
    b = values.band(F.col("value"), [(5, "minor"), (20, "light"), (60, "moderate"), (120, "strong")], "great")
    return src.table(spark, d, "events").groupBy(b.alias("band")).agg(F.count("*").alias("n"))


def _out(up: bool) -> str:
    s = "pow(10.0::DOUBLE, floor(log10(abs(value))) - 1)"
    return f"round(CASE WHEN value = 0 THEN 0.0 ELSE {'ceil' if up else 'floor'}(value / {s} {'-' if up else '+'} 1e-9) * {s} END, 6)"


@C.add("round_2sf", f"SELECT event_id, {_out(False)} AS low, {_out(True)} AS high FROM events WHERE value IS NOT NULL")
def round_2sf(spark, d):
    v = F.col("value")
    return src.table(spark, d, "events").where(v.isNotNull()).select("event_id", F.round(values.outward_2sf(v, False), 6).alias("low"), F.round(values.outward_2sf(v, True), 6).alias("high"))


@C.add("vector_group", "SELECT p_partkey, least(greatest(round(p_size * 1.0), 0), 255)::INT AS a, least(greatest(round(p_retailprice / 4), 0), 255)::INT AS b, 0 AS c FROM part")
def vector_group(spark, d):
    v = values.vector([F.col("p_size"), F.col("p_retailprice") / 4, F.lit(None)], as_bytes=True)
    return src.table(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"))


@C.add("coord_quantize", f"WITH {POINTS} SELECT feature_id, round((lon + 180) / 0.0009::DOUBLE)::BIGINT AS qx, round((lat + 90) / 0.0009::DOUBLE)::BIGINT AS qy FROM pts")
def coord_quantize(spark, d):
    return src.points(spark, d).select("feature_id", values.quantized(F.col("lon"), F.lit(-180), F.lit(0.0009)).alias("qx"), values.quantized(F.col("lat"), F.lit(-90), F.lit(0.0009)).alias("qy"))


@C.add("reproject_mercator", f"WITH {POINTS} SELECT feature_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pts")
def reproject_mercator(spark, d):
    p = src.points(spark, d)
    r = 6378137.0
    there = p.select("feature_id", (F.radians("lon") * r).alias("mx"), (F.asinh(F.tan(F.radians("lat"))) * r).alias("my"))
    lon, lat = space.lon_lat_of_mercator(F.col("mx"), F.col("my"))
    return there.select("feature_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@C.add("vertex_stats", f"WITH {POINTS}, t AS (SELECT user_id, count(*) AS n FROM pts GROUP BY 1), s AS (SELECT list_sort(list(n)) AS s, count(*) AS k, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM t) SELECT k AS tracks, low, high, mean, s[k // 2 + 1] AS median, s[least(floor(k * 0.95::DOUBLE), k - 1)::BIGINT + 1] AS p95, s[least(floor(k * 0.99::DOUBLE), k - 1)::BIGINT + 1] AS p99 FROM s")
def vertex_stats(spark, d):
    t = src.points(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    s = t.agg(F.array_sort(F.collect_list("n")).alias("s"), F.count("*").alias("tracks"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"))
    at = lambda q: values.at_index(F.col("s"), F.floor(F.size("s") * F.lit(q)))
    return s.select("tracks", "low", "high", "mean", at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@C.add("compact_feature_times", f"WITH {placed_sql(4, DAY)} SELECT feature_id, start_ms - bucket_ms AS start_delta, end_ms - start_ms AS duration FROM placed")
def compact_times(spark, d):
    p = tiling.place(src.points(spark, d), 4, DAY)
    return p.select("feature_id", (F.col("start_ms") - F.col("bucket_ms")).alias("start_delta"), (F.col("end_ms") - F.col("start_ms")).alias("duration"))


@C.add("duration_format", f"WITH {POINTS} SELECT feature_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S') AS stamp FROM pts")
def duration_format(spark, d):
    return src.points(spark, d).select("feature_id", F.substring(timing.rfc3339(F.col("start_ms")), 1, 19).alias("stamp"))
