"""Queries on statistics and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import profile, tiling
from tilewright.plans.base import DAY, HOUR, POINTS, Catalogue, placed_sql, x_sql, y_sql
from tilewright.sources import features as src

C = Catalogue()


@C.add("dataset_extent", f"WITH {POINTS} SELECT count(*) AS n, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, min(start_ms) AS min_start_ms, max(end_ms) AS max_end_ms FROM pts")
def dataset_extent(spark, d):
    return profile.extent(src.points(spark, d))


@C.add("column_stats", "SELECT min(value) AS low, max(value) AS high, max(abs(value)) AS max_abs, bool_and(value = floor(value)) AS all_integer, count(value) AS finite, count(*) - count(value) AS nulls, count(DISTINCT value) AS n_distinct FROM events")
def column_stats(spark, d):
    return profile.column_stats(src.points(spark, d), "value")


def _pin_sql(c: str) -> str:
    whole, span = f"coalesce(bool_and({c} = floor({c})), false)", f"max({c}) - min({c})"
    return f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 0.0 WHEN NOT max(abs({c})) >= 2147483647 THEN min({c})::DOUBLE END AS "offset",
      round(CASE WHEN count({c}) = 0 THEN 1.0::DOUBLE WHEN max(abs({c})) >= 2147483647 THEN NULL WHEN ({whole} AND {span} <= 2147483647) OR {span} = 0 THEN 1.0::DOUBLE ELSE ({span})::DOUBLE / 65535 END, 9) AS step,
      CASE WHEN count({c}) = 0 THEN 'u16' WHEN max(abs({c})) >= 2147483647 THEN 'refused' WHEN {whole} AND {span} <= 65535 THEN 'u16' WHEN {whole} AND {span} <= 2147483647 THEN 'i32' ELSE 'u16' END AS kind FROM pts"""


_PINNED = ("value", "lon", "user_id", "feature_id", "start_ms")


@C.add("auto_quant_pins", f"WITH {POINTS} " + " UNION ALL ".join(map(_pin_sql, _PINNED)))
def auto_quant_pins(spark, d):
    return profile.pins(src.points(spark, d), list(_PINNED)).withColumn("step", F.round("step", 9))


@C.add(
    "dict_verdict",
    """WITH v AS (SELECT event_type AS v, count(*) AS n, strlen(event_type) AS size FROM events WHERE event_type IS NOT NULL GROUP BY ALL),
    s AS (SELECT count(*) AS categories, sum(size * n)::BIGINT + 4 * (sum(n)::BIGINT + 1) AS plain_bytes, sum(size)::BIGINT + 4 * (count(*) + 1) + 2 * sum(n)::BIGINT + 256 AS dictionary_bytes, sum(size) AS own FROM v)
    SELECT categories, plain_bytes, dictionary_bytes, dictionary_bytes < plain_bytes AND categories <= 1024 AND own <= 4096 AS dictionary FROM s""",
)
def dict_verdict(spark, d):
    return profile.dictionary_verdict(src.points(spark, d), "event_type")


_HIST = f"WITH {POINTS}, e AS (SELECT min(start_ms) AS lo, max(start_ms) - min(start_ms) + 1 AS span FROM pts), h AS (SELECT ((start_ms - lo) * 64) // span AS bin, lo, span, count(*) AS n FROM pts, e GROUP BY ALL), g AS (SELECT bin, n, lo + (bin * span) // 64 AS edge FROM h)"


@C.add("time_histogram", f"{_HIST} SELECT * FROM g")
def time_histogram(spark, d):
    return profile.time_histogram(src.points(spark, d), 64)


_QS = (0.1, 0.25, 0.5, 0.9)


@C.add("time_quantile_boundaries", f"{_HIST}, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM g) SELECT q::DOUBLE AS q, min(edge) AS boundary FROM c, (SELECT unnest([{', '.join(map(str, _QS))}]) AS q) WHERE upto >= greatest(1, least(ceil(q * total), total)) GROUP BY ALL")
def time_quantile_boundaries(spark, d):
    return profile.time_quantiles(src.points(spark, d), 64, list(_QS))


def _out(v: str, up: bool) -> str:
    scale = f"pow(10.0::DOUBLE, floor(log10(abs({v}))) - 1)"
    return f"CASE WHEN {v} = 0 THEN 0.0 ELSE {'ceil' if up else 'floor'}({v} / {scale} {'-' if up else '+'} 1e-9) * {scale} END"


@C.add(
    "style_hints_numeric",
    "WITH s AS (SELECT list_sort(list(value)) AS s, count(value) AS n FROM events WHERE value IS NOT NULL), h AS (SELECT s[1] AS low, "
    + ", ".join(f"s[least(floor(n * {q}::DOUBLE), n - 1)::BIGINT + 1] AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.97, 0.99))
    + f", s[n] AS high FROM s) SELECT *, round({_out('low', False)}, 6) AS domain_low, round({_out('p97', True)}, 6) AS domain_high FROM h",
)
def style_hints_numeric(spark, d):
    return profile.style_numeric(src.points(spark, d), "value").withColumn("domain_low", F.round("domain_low", 6)).withColumn("domain_high", F.round("domain_high", 6))


@C.add("style_hints_categorical", "SELECT event_type AS category, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def style_hints_categorical(spark, d):
    return profile.style_categorical(src.points(spark, d), "event_type")


@C.add("heatmap_offline", 'WITH h AS (SELECT event_type AS "class", list_sort(list(value)) AS s, count(*) AS n FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) SELECT "class", s[1] AS low, s[least(floor(n * 0.95::DOUBLE), n - 1)::BIGINT + 1] AS high FROM h ORDER BY 1 LIMIT 8')
def heatmap_offline(spark, d):
    return profile.heatmap(src.points(spark, d), "value", "event_type")


@C.add("heatmap_served", 'SELECT event_type AS "class", min(value) AS low, round(quantile_cont(value, 0.95), 6) AS high FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL ORDER BY 1 LIMIT 8')
def heatmap_served(spark, d):
    return profile.heatmap(src.points(spark, d), "value", "event_type", served=True).withColumn("high", F.round("high", 6))


@C.add("fingerprint", f"WITH {POINTS} SELECT count(*) AS n, count(DISTINCT feature_id) AS n_ids, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, min(start_ms) AS t_min, max(end_ms) AS t_max FROM pts")
def fingerprint(spark, d):
    return profile.fingerprint(src.points(spark, d))


@C.add("distinct_ids_hll")
def distinct_ids_hll(spark, d):
    return profile.fingerprint(src.points(spark, d), sketch=True)


@C.add("type_inference", "SELECT false AS p_brand, true AS size_text, false AS p_type FROM (SELECT count(*) FROM part)")
def type_inference(spark, d):
    part = src.table(spark, d, "part").withColumn("size_text", F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return src.inferred_numeric(part, ["p_brand", "size_text", "p_type"])


_PYR = f"WITH {POINTS}, t AS (SELECT z AS zoom, {x_sql('z')} AS x, {y_sql('z')} AS y, count(*) AS n FROM pts, range(0, 11) t(z) GROUP BY ALL)"


@C.add("coverage_by_zoom", f"{_PYR} SELECT zoom, count(*) AS tiles, round(avg(n), 6) AS avg_n, max(n) AS max_n, list_sort(list(n))[count(*) // 2 + 1] AS median_n, count(*) / pow(4.0::DOUBLE, zoom) AS share FROM t GROUP BY zoom")
def coverage_by_zoom(spark, d):
    return profile.coverage(src.points(spark, d), 0, 10).withColumn("avg_n", F.round("avg_n", 6))


@C.add("hotspots", f"WITH {POINTS}, g AS (SELECT floor(lon / 10)::BIGINT AS gx, floor(lat / 10)::BIGINT AS gy, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM pts GROUP BY 1, 2), m AS (SELECT *, avg(n) OVER () AS m FROM g) SELECT gx, gy, n, lon, lat FROM m WHERE n > 2 * m AND n > 10 ORDER BY n DESC, gx, gy LIMIT 10")
def hotspots(spark, d):
    return profile.hotspots(src.points(spark, d), least=10).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@C.add(
    "density_by_zoom",
    f"""WITH {POINTS}, t AS (SELECT z AS zoom, {x_sql('z')} AS x, {y_sql('z')} AS y, start_ms - start_ms % {DAY} AS b, count(*) AS n FROM pts, range(2, 7) t(z) GROUP BY ALL),
    r AS (SELECT zoom, n, row_number() OVER (PARTITION BY zoom ORDER BY n) AS up, row_number() OVER (PARTITION BY zoom ORDER BY n DESC) AS down, count(*) OVER (PARTITION BY zoom) AS k FROM t)
    SELECT zoom, count(*) AS tiles, round(avg(n), 6) AS avg_n, max(CASE WHEN up = k // 2 + 1 THEN n END) AS median_n, max(CASE WHEN up = ceil(k * 0.95::DOUBLE) THEN n END) AS p95_n, max(n) AS max_n,
           round(sum(CASE WHEN down <= greatest(1, ceil(k * 0.01::DOUBLE)) THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS top_share, 0::BIGINT AS oversized, count(*) FILTER (n < 10) AS undersized FROM r GROUP BY zoom""",
)
def density_by_zoom(spark, d):
    return profile.density(src.points(spark, d), (2, 6), DAY).withColumns({"avg_n": F.round("avg_n", 6), "top_share": F.round("top_share", 9)})


@C.add("hour_dow_month", " UNION ALL ".join(f"SELECT '{k}' AS kind, {e}::BIGINT AS at, count(*) AS n FROM events GROUP BY ALL" for k, e in (("hour", "hour(ts)"), ("weekday", "dayofweek(ts)"), ("month", "month(ts) - 1"))))
def hour_dow_month(spark, d):
    return profile.calendar(src.points(spark, d))


_DAYS = f"WITH {POINTS}, d AS (SELECT start_ms // {DAY} AS day, count(*) AS n FROM pts GROUP BY 1)"


@C.add("events_per_day", f"{_DAYS} SELECT count(*) AS days, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS median, round(stddev_pop(n), 6) AS deviation FROM d")
def events_per_day(spark, d):
    return profile.per_day(src.points(spark, d)).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


_CASES = " ".join(f"WHEN duration // {w} <= target THEN {w}" for w in (1000, 60000, 300000, 600000, 900000, 1800000, 3600000, 7200000, 14400000, 21600000, 43200000, 86400000, 604800000, 2592000000))


@C.add(
    "bucket_recommendation",
    f"""{_DAYS}, t AS (SELECT count(*) AS n, max(start_ms) - min(start_ms) AS duration, count(DISTINCT start_ms) AS stamps FROM pts), s AS (SELECT avg(n) AS mean, stddev_pop(n) AS deviation FROM d),
    h AS (SELECT (max(c) - CASE WHEN count(*) = 24 THEN min(c) ELSE 0 END) / (sum(c) / 24) AS variation FROM (SELECT (start_ms // {HOUR}) % 24 AS h, count(*) AS c FROM pts GROUP BY 1)),
    k AS (SELECT *, CASE WHEN duration < {DAY} THEN 'Instantaneous' WHEN stamps < 100 AND duration > {30 * DAY} THEN 'Sparse' WHEN deviation > 1.5 * mean THEN 'Bursty' WHEN variation > 2 THEN 'Periodic' ELSE 'Uniform' END AS kind FROM t, s, h),
    g AS (SELECT kind, duration, least(CASE kind WHEN 'Bursty' THEN 2025 WHEN 'Sparse' THEN 675 ELSE 1350 END, stamps, greatest(1, n // 10)) AS target FROM k)
    SELECT kind, target, (CASE {_CASES} ELSE 2592000000 END)::BIGINT AS width_ms FROM g""",
)
def bucket_recommendation(spark, d):
    return profile.bucket_recommendation(src.points(spark, d))


@C.add(
    "max_zoom_recommendation",
    f"""WITH {POINTS}, e AS (SELECT count(*) AS n, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS t FROM pts), g AS (SELECT n, cos(radians((s + t) / 2)) AS c, (e - w) / 360 * 40075016.686::DOUBLE AS wide, (t - s) / 360 * 40075016.686::DOUBLE AS tall FROM e)
    SELECT n, least(greatest(round(log2(40075016.686::DOUBLE * c / sqrt(greatest(wide * c, 152.9) * greatest(tall, 152.9) / n))), 0), 18)::BIGINT AS max_zoom FROM g""",
)
def max_zoom_recommendation(spark, d):
    return profile.max_zoom(src.points(spark, d))


_TILES = f"WITH {placed_sql(4, 6 * HOUR)}, t AS (SELECT zoom, x, y, bucket_ms, count(*) AS n, min(start_ms) AS cover_t_min, max(start_ms + (feature_id % 9) * {2 * HOUR}) AS time_end FROM placed GROUP BY ALL)"


def _tiles(spark, d):
    p = src.points(spark, d).withColumn("end_ms", F.col("start_ms") + F.pmod("feature_id", F.lit(9)) * (2 * HOUR))
    return tiling.index(tiling.place(p, 4, 6 * HOUR))


@C.add(
    "read_amplification",
    f"""{_TILES}, z AS (SELECT min(cover_t_min) AS t0 FROM t), k AS (SELECT *, (cover_t_min - t0) // {HOUR} AS f, (time_end - t0) // {HOUR} AS l, greatest((bucket_ms + {6 * HOUR} - t0) // {HOUR}, (cover_t_min - t0) // {HOUR}) AS tail, least(greatest(0, time_end - bucket_ms - {6 * HOUR}) // {HOUR}, 15) AS residual FROM t, z)
    SELECT residual, count(*) AS tiles, sum((l - f + 1) * n)::BIGINT AS hit_size, sum(greatest(l - tail + 1, 0) * n)::BIGINT AS trailing_size FROM k GROUP BY residual""",
)
def read_amplification(spark, d):
    return profile.read_amplification(_tiles(spark, d), 6 * HOUR, HOUR)


@C.add("inspect_directory", f"{_TILES} SELECT zoom, count(*) AS entries, count(DISTINCT n) AS blobs, sum(n)::BIGINT AS total, max(n) AS largest, round(avg(n), 6) AS mean, count(DISTINCT bucket_ms) AS buckets FROM t GROUP BY zoom")
def inspect_directory(spark, d):
    return profile.inspect(_tiles(spark, d)).withColumn("mean", F.round("mean", 6))


@C.add("diff_two_builds", f"WITH {POINTS}, a AS (SELECT user_id % 7 AS zoom, count(*) AS n FROM pts WHERE user_id % 7 < 6 GROUP BY 1), b AS (SELECT user_id % 9 AS zoom, count(*) AS n FROM pts WHERE value > 10 GROUP BY 1) SELECT coalesce(a.zoom, b.zoom) AS zoom, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.zoom = b.zoom")
def diff_two_builds(spark, d):
    p = src.points(spark, d)
    count = lambda df, k: df.groupBy(F.pmod("user_id", F.lit(k)).alias("zoom")).agg(F.count("*").alias("n"))
    return profile.diff(count(p, 7).where("zoom < 6"), count(p.where("value > 10"), 9))
