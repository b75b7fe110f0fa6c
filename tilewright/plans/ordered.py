"""Queries on order and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import joins, ordered, tiling
from tilewright.plans.base import DAY, HOUR, POINTS, SPANS, T0, Catalogue, placed_sql
from tilewright.sources import features as src

C = Catalogue()
_BY = "OVER (PARTITION BY user_id ORDER BY start_ms, feature_id)"
_SEG = f"""WITH {POINTS}, f AS (SELECT *, CASE WHEN lag(start_ms) {_BY} IS NULL OR start_ms - lag(start_ms) {_BY} > {DAY} OR abs(lon - lag(lon) {_BY}) > 180 THEN 1 ELSE 0 END AS new FROM pts),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, feature_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM f)"""


@C.add("sessionize_gap", f"{_SEG} SELECT user_id, segment, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM s GROUP BY ALL HAVING count(*) >= 2")
def sessionize_gap(spark, d):
    return ordered.segment_index(ordered.segments(src.points(spark, d), "user_id", DAY), "user_id")


@C.add(
    "forward_backward_fill",
    f"WITH {POINTS}, k AS (SELECT *, CASE WHEN feature_id % 3 = 0 THEN value END AS known FROM pts) SELECT feature_id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, feature_id ROWS UNBOUNDED PRECEDING), first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, feature_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM k",
)
def forward_backward_fill(spark, d):
    k = src.points(spark, d).withColumn("known", F.when(F.col("feature_id") % 3 == 0, F.col("value")))
    return ordered.filled(k, "user_id", "known").select("feature_id", "filled")


@C.add(
    "bearing_per_point",
    f"WITH {POINTS}, n AS (SELECT feature_id, lon, lat, lead(lon) {_BY} AS lon2, lead(lat) {_BY} AS lat2 FROM pts), a AS (SELECT feature_id, degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) AS a FROM n) SELECT feature_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 5) AS bearing FROM a",
)
def bearing_per_point(spark, d):
    return ordered.bearings(src.points(spark, d), "user_id").select("feature_id", F.round("bearing", 5).alias("bearing"))


def _hav(a: str, b: str, c: str, e: str) -> str:
    h = f"(pow(sin((radians({e}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({e})) * pow(sin(radians({c} - {a}) / 2), 2))"
    return f"2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h})))"


_LEGS = f"WITH {POINTS}, n AS (SELECT *, lag(lon) {_BY} AS lon0, lag(lat) {_BY} AS lat0 FROM pts), g AS (SELECT *, coalesce({_hav('lon0', 'lat0', 'lon', 'lat')}, 0.0) AS leg_km FROM n)"


@C.add("haversine_legs", f"{_LEGS} SELECT feature_id, round(leg_km, 5) AS leg_km FROM g")
def haversine_legs(spark, d):
    return ordered.legs(src.points(spark, d), "user_id").select("feature_id", F.round("leg_km", 5).alias("leg_km"))


@C.add("vertex_time_by_distance", f"{_LEGS}, s AS (SELECT user_id, feature_id, round(sum(leg_km) OVER (PARTITION BY user_id ORDER BY start_ms, feature_id ROWS UNBOUNDED PRECEDING) / nullif(sum(leg_km) OVER (PARTITION BY user_id), 0), 6) AS share FROM g) SELECT feature_id, coalesce(share, 0) AS share FROM s")
def vertex_time_by_distance(spark, d):
    t = ordered.vertex_times(src.points(spark, d), "user_id")
    return t.select("feature_id", F.coalesce(F.round(F.col("done_km") / F.col("all_km"), 6), F.lit(0.0)).alias("share"))


@C.add("dense_renumber", f"WITH {POINTS}, m AS (SELECT user_id, min(start_ms) AS first_ms FROM pts GROUP BY 1) SELECT user_id, first_ms, row_number() OVER (ORDER BY first_ms, user_id) - 1 AS dense FROM m")
def dense_renumber(spark, d):
    return ordered.dense_numbers(src.points(spark, d), "user_id")


@C.add("row_index_ids", f"WITH {placed_sql(4, DAY)} SELECT feature_id, zoom, x, y, bucket_ms, row_number() OVER (PARTITION BY zoom, x, y, bucket_ms ORDER BY start_ms, feature_id) - 1 AS row_id FROM placed")
def row_index_ids(spark, d):
    return ordered.row_ids(tiling.place(src.points(spark, d), 4, DAY)).select("feature_id", "zoom", "x", "y", "bucket_ms", "row_id")


@C.add("first_wins_dedup", f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_ms // {DAY} ORDER BY start_ms, feature_id) AS k FROM pts) SELECT user_id, start_ms - start_ms % {DAY} AS slot_ms, start_ms, feature_id, event_type, value FROM r WHERE k = 1")
def first_wins_dedup(spark, d):
    return ordered.first_wins(src.points(spark, d), "user_id", DAY).select("user_id", "slot_ms", "start_ms", "feature_id", "event_type", "value")


@C.add("duplicate_ids", "SELECT user_id % 1000 AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return src.points(spark, d).groupBy(F.pmod("user_id", F.lit(1000)).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@C.add("throttle_per_key")
def throttle_per_key(spark, d):
    return ordered.throttle(src.points(spark, d), "user_id", 6 * HOUR)


@C.add("adaptive_windows")
def adaptive_windows(spark, d):
    return ordered.adaptive_windows(tiling.place(src.points(spark, d), 2), 50)


@C.add("stratified_sample")
def stratified_sample(spark, d):
    return ordered.stratified(tiling.index(tiling.place(src.points(spark, d), 4, DAY)), 100)


@C.add("track_resample", f"""WITH {POINTS}, n AS (SELECT user_id, start_ms, lon, lat, lead(start_ms) {_BY} AS t1, lead(lon) {_BY} AS lon1, lead(lat) {_BY} AS lat1 FROM pts),
 s AS (SELECT *, unnest(range(((start_ms + {6 * HOUR} - 1) // {6 * HOUR}) * {6 * HOUR}, t1, {6 * HOUR})) AS at_ms FROM n WHERE t1 IS NOT NULL)
 SELECT user_id, at_ms, round(lon + (at_ms - start_ms) / (t1 - start_ms) * (lon1 - lon), 6) AS lon, round(lat + (at_ms - start_ms) / (t1 - start_ms) * (lat1 - lat), 6) AS lat FROM s""")
def track_resample(spark, d):
    return ordered.resample(src.points(spark, d), "user_id", 6 * HOUR).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


_BOUNDS = [T0 + k * k * HOUR for k in range(28)]


@C.add("as_of_snap_down", f"WITH {POINTS}, b AS (SELECT unnest([{', '.join(map(str, _BOUNDS))}])::BIGINT AS b) SELECT feature_id, max(b) AS boundary FROM pts LEFT JOIN b ON b <= start_ms GROUP BY feature_id")
def as_of_snap_down(spark, d):
    return src.points(spark, d).select("feature_id", joins.snap_down(F.col("start_ms"), _BOUNDS).alias("boundary"))


@C.add("as_of_join", f"WITH {POINTS}, l AS (SELECT * FROM pts WHERE event_type = 'purchase'), r AS (SELECT user_id, start_ms, max(value) AS seen FROM pts WHERE event_type = 'view' GROUP BY ALL) SELECT l.feature_id, l.user_id, r.seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.start_ms >= r.start_ms")
def as_of_join(spark, d):
    p = src.points(spark, d)
    right = p.where("event_type = 'view'").groupBy("user_id", F.col("start_ms").alias("seen_ms")).agg(F.max("value").alias("seen"))
    return joins.as_of(p.where("event_type = 'purchase'").select("feature_id", "user_id", "start_ms"), right, "user_id", "start_ms", "seen_ms", ["seen"]).select("feature_id", "user_id", "seen")


@C.add("interval_overlap", f"WITH {SPANS}, s AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, start_ms, end_ms FROM spans JOIN lineitem USING (l_orderkey, l_linenumber)) SELECT a.k, a.id AS a, b.id AS b, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM s a JOIN s b ON a.k = b.k AND a.id < b.id AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms")
def interval_overlap(spark, d):
    """Overlapping spans of one part, over all of lineitem."""
    li = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _overlaps(src.intervals(spark, d).join(li, ["l_orderkey", "l_linenumber"]), F.col("l_partkey"))


@C.add("interval_overlap_all")
def interval_overlap_all(spark, d):
    """Overlaps among all spans of 50 groups of suppliers: some hundred times as many pairs."""
    return _overlaps(src.intervals(spark, d), F.col("l_suppkey") % 50)


def _overlaps(spans, key):
    return joins.overlapping(spans.select(key.alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "start_ms", "end_ms"), "k")


@C.add("anti_unmatched", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unmatched(spark, d):
    orders = src.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmatched(src.table(spark, d, "customer"), orders, "c_custkey").select("c_custkey", "c_nationkey")


_TRIPS = f"trips AS (SELECT c_nationkey::BIGINT AS origin, s_nationkey::BIGINT AS destination, epoch_us(l_shipdate) // 1000 AS start_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def _trips(spark, d):
    s = src.intervals(spark, d).select("o_custkey", "l_suppkey", F.col("raw_end").alias("start_ms"))
    c = src.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("origin"))
    p = src.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("destination"))
    return s.join(c, s.o_custkey == c.c_custkey).join(p, s.l_suppkey == p.s_suppkey).select("origin", "destination", "start_ms")


@C.add("od_bins", f"WITH {_TRIPS} SELECT origin, destination, start_ms - start_ms % {30 * DAY} AS bin_ms, count(*) AS n FROM trips WHERE origin <> destination GROUP BY ALL")
def od_bins(spark, d):
    return joins.flows(_trips(spark, d), 30 * DAY)


@C.add("od_fold_to_day", f"WITH {POINTS} SELECT (start_ms // {HOUR}) % 24 AS slot, count(*) AS n FROM pts WHERE user_id % 7 <> feature_id % 7 GROUP BY ALL")
def od_fold_to_day(spark, d):
    t = src.points(spark, d).select((F.col("user_id") % 7).alias("origin"), (F.col("feature_id") % 7).alias("destination"), "start_ms")
    return joins.fold(joins.flows(t, HOUR), HOUR, DAY)


@C.add("flow_value_matrix", f"WITH {_TRIPS}, b AS (SELECT origin, destination, (start_ms // {30 * DAY}) % 12 AS slot, count(*) AS n FROM trips WHERE origin <> destination GROUP BY ALL), k AS (SELECT DISTINCT origin, destination FROM b) SELECT k.origin, k.destination, {', '.join(f'coalesce(sum(n) FILTER (slot = {i}), 0)::BIGINT AS s{i}' for i in range(12))} FROM k JOIN b USING (origin, destination) GROUP BY ALL")
def flow_value_matrix(spark, d):
    b = joins.flows(_trips(spark, d), 30 * DAY).withColumn("slot", F.pmod(F.floor(F.col("bin_ms") / (30 * DAY)), F.lit(12)).cast("long"))
    m = joins.dense_matrix(b, ["origin", "destination"], 12)
    return m.select("origin", "destination", *[F.col("values")[i].cast("long").alias(f"s{i}") for i in range(12)])


@C.add(
    "calendar_active_services",
    """WITH cal AS (SELECT s_suppkey AS service, s_suppkey % 300 AS first_day, s_suppkey % 300 + 90 AS last_day, s_suppkey % 128 AS weekdays FROM supplier),
    ex AS (SELECT l_suppkey AS service, l_partkey % 365 AS day, l_linenumber % 2 + 1 AS kind FROM lineitem)
    SELECT service FROM (SELECT service FROM cal WHERE first_day <= 100 AND last_day >= 100 AND (weekdays >> 2) & 1 = 1 UNION SELECT service FROM ex WHERE day = 100 AND kind = 1) WHERE service NOT IN (SELECT service FROM ex WHERE day = 100 AND kind = 2)""",
)
def calendar_active_services(spark, d):
    s, li = src.table(spark, d, "supplier"), src.table(spark, d, "lineitem")
    k = F.col("s_suppkey")
    cal = s.select(k.alias("service"), (k % 300).alias("first_day"), (k % 300 + 90).alias("last_day"), (k % 128).alias("weekdays"))
    ex = li.select(F.col("l_suppkey").alias("service"), (F.col("l_partkey") % 365).alias("day"), (F.col("l_linenumber") % 2 + 1).alias("kind"))
    return joins.active_services(cal, ex, 100)


@C.add(
    "grid_nearest_match",
    f"""WITH {POINTS}, a AS (SELECT feature_id AS a, lon AS x, lat AS y FROM pts WHERE feature_id % 2 = 1), b AS (SELECT feature_id AS b, lon AS x, lat AS y FROM pts WHERE feature_id % 2 = 0),
    j AS (SELECT a, b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM a JOIN b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
    SELECT a, round(min(d2), 9) AS d2 FROM j WHERE d2 <= 1 GROUP BY a""",
)
def grid_nearest_match(spark, d):
    """Points of odd ids against those of even ids: every point is on one side."""
    p = src.points(spark, d)
    a, b = (p.where(F.pmod("feature_id", F.lit(2)) == k).select(F.col("feature_id").alias(n), F.col("lon").alias("x"), F.col("lat").alias("y")) for k, n in ((1, "a"), (0, "b")))
    return joins.nearest_on_grid(a, b, 1.0, 1.0, ids=False).select("a", F.round("d2", 9).alias("d2"))


@C.add("inventory_fill", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def inventory_fill(spark, d):
    c = src.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("label"))
    return joins.filled_from(c, src.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label")), "k", ["label"]).select("c_custkey", "label")
