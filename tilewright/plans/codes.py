"""Queries on payloads, blobs, packs, pages, budgets, ids, clocks and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import codes, timing
from tilewright.operators import joins, payload, tiling
from tilewright.plans.base import DAY, HOUR, POINTS, T0, Catalogue, placed_sql
from tilewright.sources import features as src

C = Catalogue()
_COLUMNS = ["feature_id", "start_ms", "lon", "lat", "value", "event_type"]


def _placed(spark, d, zoom=4, width=DAY):
    return tiling.place(src.points(spark, d), zoom, width)


@C.add("payload_round_trip", f"WITH {placed_sql(4, DAY)} SELECT zoom, x, y, bucket_ms, feature_id, start_ms, lon, lat, value, event_type FROM placed")
def payload_round_trip(spark, d):
    p = _placed(spark, d)
    return payload.decode(payload.encode(p, _COLUMNS), p.select(*_COLUMNS).schema).select("zoom", "x", "y", "bucket_ms", *_COLUMNS)


@C.add("content_addressing", f"WITH {placed_sql(6, 6 * HOUR)}, t AS (SELECT list(event_type ORDER BY event_type) AS types FROM placed GROUP BY zoom, x, y, bucket_ms) SELECT count(*) AS tiles, count(DISTINCT types) AS blobs FROM t")
def content_addressing(spark, d):
    tiles = payload.encode(_placed(spark, d, 6, 6 * HOUR), ["event_type"], ("event_type",))
    return payload.blobs(tiles).agg(F.sum("uses").alias("tiles"), F.count("*").alias("blobs"))


_DIRECTORY = f"{placed_sql(6, 6 * HOUR)}, dir AS (SELECT zoom, x, y, bucket_ms, count(*) AS n, min(start_ms) AS cover_t_min, max(end_ms) AS time_end FROM placed GROUP BY ALL)"
_ORDER = ["x", "y", "bucket_ms"]


@C.add("pack_plan", f"WITH {_DIRECTORY}, r AS (SELECT x, y, bucket_ms, n * 100 AS bytes, sum(n * 100) OVER (ORDER BY x, y, bucket_ms) - n * 100 AS start FROM dir), p AS (SELECT *, start // 10000 AS pack FROM r) SELECT x, y, bucket_ms, pack::BIGINT AS pack, (start - min(start) OVER (PARTITION BY pack))::BIGINT AS \"offset\" FROM p")
def pack_plan(spark, d):
    tiles = tiling.index(_placed(spark, d, 6, 6 * HOUR)).withColumn("bytes", F.col("n") * 100)
    return payload.packs(tiles, _ORDER, 10_000).select("x", "y", "bucket_ms", "pack", "offset")


_PAGES = f"{_DIRECTORY}, r AS (SELECT *, (row_number() OVER (ORDER BY x, y, bucket_ms) - 1) // 64 AS page FROM dir), pages AS (SELECT page, zoom, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(cover_t_min) AS t0, max(time_end) AS t1 FROM r GROUP BY ALL)"


@C.add("directory_pages", f"WITH {_PAGES} SELECT * FROM pages")
def directory_pages(spark, d):
    return payload.pages(tiling.index(_placed(spark, d, 6, 6 * HOUR)), _ORDER, 64)


@C.add("page_prune", f"WITH {_PAGES} SELECT * FROM pages WHERE zoom = 6 AND x1 >= 10 AND x0 <= 30 AND y1 >= 20 AND y0 <= 40 AND t1 >= {T0 + DAY} AND t0 <= {T0 + 9 * DAY}")
def page_prune(spark, d):
    return directory_pages(spark, d).where(payload.page_meets((10, 30), (20, 40), 6, (T0 + DAY, T0 + 9 * DAY)))


@C.add("byte_budget")
def byte_budget(spark, d):
    p = _placed(spark, d, 3).withColumn("size", F.length("event_type") + F.col("feature_id") % 50 + 20)
    return payload.byte_budget(p, 400, 12_000, "value", "size").select("zoom", "x", "y", "feature_id", "size")


_FNV = "list_reduce([14695981039346656037::HUGEINT] || [ord(c)::HUGEINT for c in string_split({0}, '')], lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)"


@C.add("feature_ids", f"SELECT c_custkey, CASE WHEN h >= 9223372036854775808 THEN (h - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS id FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::HUGEINT ELSE {_FNV.format('c_name')} END AS h FROM customer)")
def feature_ids(spark, d):
    c = src.table(spark, d, "customer")
    source = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return c.select("c_custkey", codes.feature_id(source, F.lit(0.0), F.lit(0.0), F.lit(0)).alias("id"))


@C.add("id_attestation", "SELECT 'event_id' AS id, count(*) AS n, count(DISTINCT event_id) AS ids, count(*) = count(DISTINCT event_id) AS is_key FROM events UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), count(*) = count(DISTINCT user_id) FROM events")
def id_attestation(spark, d):
    e = src.table(spark, d, "events")
    found = e.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in ("event_id", "user_id")])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("id"), F.col("n"), F.col(c).alias("ids"), (F.col("n") == F.col(c)).alias("is_key")) for c in ("event_id", "user_id")])))


@C.add("zigzag_codes", "SELECT event_id, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS code, d AS back FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS d FROM events)")
def zigzag_codes(spark, d):
    v = src.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id")).alias("d"))
    return v.select("event_id", codes.zigzag(F.col("d")).alias("code"), codes.unzigzag(codes.zigzag(F.col("d"))).alias("back"))


@C.add("tile_relative", f"WITH {placed_sql(6)} SELECT feature_id, round(((lon + 180) / 360 * 64 - x) * 4096)::INT AS px, round(((1 - asinh(tan(radians(lat))) / pi()) / 2 * 64 - y) * 4096)::INT AS py FROM placed")
def tile_relative(spark, d):
    px, py = codes.tile_relative(F.col("lon"), F.col("lat"), 6, F.col("x"), F.col("y"))
    return tiling.place(src.points(spark, d), 6).select("feature_id", px.alias("px"), py.alias("py"))


@C.add("service_clock", "SELECT l_orderkey, l_linenumber, ((l_orderkey % 30) * 3600 + (l_linenumber % 60) * 60 + l_suppkey % 60)::BIGINT AS seconds FROM lineitem")
def service_clock(spark, d):
    text = F.format_string("%d:%02d:%02d", F.col("l_orderkey") % 30, F.col("l_linenumber") % 60, F.col("l_suppkey") % 60)
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.clock_seconds(text).alias("seconds"))


@C.add("fold_to_year", "SELECT event_id, epoch_us(make_timestamp(2000, month(ts), day(ts), 0, 0, 0.0)) // 1000 + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS folded FROM events")
def fold_to_year(spark, d):
    return src.points(spark, d).select(F.col("feature_id").alias("event_id"), codes.fold_to_year(F.col("start_ms"), 2000).alias("folded"))


@C.add("log_scales", "SELECT event_id, round(least(greatest((log10(greatest(value, 0.5)) - log10(0.5)) / (log10(200.0) - log10(0.5)), 0), 1), 9) AS share, round(least(greatest(log2(value / 10), -3), 3), 9) AS anomaly FROM events WHERE value > 0")
def log_scales(spark, d):
    v = F.col("value")
    return src.table(spark, d, "events").where(v > 0).select("event_id", F.round(codes.log_scaled(v, 0.5, 200.0), 9).alias("share"), F.round(codes.log_anomaly(v, F.lit(10.0)), 9).alias("anomaly"))


@C.add("playback_hint", f"SELECT least(greatest(round(sqrt(ceil((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / {float(HOUR)}))), 20), 90)::INT AS seconds FROM events")
def playback_hint(spark, d):
    return src.points(spark, d).agg((F.max("start_ms") - F.min("start_ms")).alias("span")).select(codes.playback_seconds(F.col("span"), HOUR).alias("seconds"))


@C.add("common_nations", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_nations(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(src.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@C.add("null_fill_union", "SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS balance, NULL::INT AS size FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, NULL FROM customer UNION ALL SELECT p_partkey, NULL, NULL, p_size FROM part")
def null_fill_union(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return s.unionByName(c, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@C.add("edge_flows", f"WITH {POINTS}, s AS (SELECT floor(lon / 15)::BIGINT * 1000 + floor(lat / 15)::BIGINT AS b, lag(floor(lon / 15)::BIGINT * 1000 + floor(lat / 15)::BIGINT) OVER (PARTITION BY user_id ORDER BY start_ms, feature_id) AS a, start_ms - start_ms % {DAY} AS bin_ms FROM pts) SELECT a, b, bin_ms, count(*) AS n FROM s WHERE a IS NOT NULL AND a <> b GROUP BY ALL")
def edge_flows(spark, d):
    cell = F.floor(F.col("lon") / 15) * 1000 + F.floor(F.col("lat") / 15)
    return joins.edge_flows(src.points(spark, d).withColumn("cell", cell.cast("long")), "user_id", "cell", DAY)


@C.add("daily_means", f"WITH {POINTS}, h AS (SELECT event_type, start_ms - start_ms % {HOUR} AS hour_ms, avg(value) AS v FROM pts WHERE value >= 5 GROUP BY ALL) SELECT event_type, hour_ms - hour_ms % {DAY} AS day_ms, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(*) AS hours FROM h GROUP BY ALL")
def daily_means(spark, d):
    known = src.points(spark, d).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return joins.daily(known, "event_type", "value", HOUR, DAY).select("event_type", "day_ms", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "hours")


@C.add("region_peak", "WITH s AS (SELECT n_regionkey, o_orderdate, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, max(n) AS peak, min(o_orderdate) FILTER (WHERE n = m) AS at FROM (SELECT *, max(n) OVER (PARTITION BY n_regionkey) AS m FROM s) GROUP BY n_regionkey")
def region_peak(spark, d):
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(src.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.peak(o.withColumn("one", F.lit(1)), "n_regionkey", "o_orderdate", "one").withColumnRenamed("time", "at")


@C.add("trip_stops", "SELECT o_orderkey AS trip, o_custkey AS route, c_mktsegment AS kind, l_linenumber AS seq, l_suppkey AS stop, s_name AS stop_name, epoch_us(l_shipdate) // 1000 AS at_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey")
def trip_stops(spark, d):
    trips = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("route"))
    times = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("stop"), timing.of_timestamp(F.col("l_shipdate")).alias("at_ms"))
    stops = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop"), F.col("s_name").alias("stop_name"))
    routes = src.table(spark, d, "customer").select(F.col("c_custkey").alias("route"), F.col("c_mktsegment").alias("kind"))
    return joins.trip_stops(trips, times, stops, routes)


@C.add("temporal_lod", f"WITH {placed_sql(4, HOUR)}, b AS (SELECT x, y, bucket_ms, count(*) AS n FROM placed GROUP BY ALL) SELECT x, y, w AS width_ms, bucket_ms - bucket_ms % w AS bucket_ms, sum(n)::BIGINT AS n FROM b, (SELECT unnest([{HOUR}, {6 * HOUR}, {DAY}]) AS w) GROUP BY ALL")
def temporal_lod(spark, d):
    base = tiling.index(_placed(spark, d, 4, HOUR)).select("x", "y", "bucket_ms", "n")
    return joins.rolled_up(base, ["x", "y"], [HOUR, 6 * HOUR, DAY])


@C.add("moving_boxes", f"WITH {POINTS}, m AS (SELECT user_id AS box, start_ms - start_ms % {6 * HOUR} AS t0, min(lon) - 1 AS w, max(lon) + 1 AS e, min(lat) - 1 AS s, max(lat) + 1 AS n FROM pts GROUP BY ALL) SELECT p.feature_id, count(*) AS boxes FROM pts p JOIN m ON p.start_ms >= t0 AND p.start_ms < t0 + {6 * HOUR} AND lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY ALL")
def moving_boxes(spark, d):
    p = src.points(spark, d)
    m = p.groupBy(F.col("user_id").alias("box"), timing.bucket(F.col("start_ms"), 6 * HOUR).alias("t0")).agg((F.min("lon") - 1).alias("west"), (F.max("lon") + 1).alias("east"), (F.min("lat") - 1).alias("south"), (F.max("lat") + 1).alias("north")).withColumn("t1", F.col("t0") + 6 * HOUR)
    return joins.in_moving_boxes(p, m, 6 * HOUR, 15.0).groupBy("feature_id").agg(F.count("*").alias("boxes"))
