"""Queries on vertex codes, voxels, grids, replication, mergeable statistics and declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import timing
from tilewright.operators import checks, joins, ordered, tiling, vertices
from tilewright.plans.base import DAY, HOUR, POINTS, Catalogue, placed_sql, x_sql, y_sql
from tilewright.sources import features as src

C = Catalogue()

# Layers of every kind: short spans, features within an hour, such features of which one begins after its first vertex, and spans beyond all steps.
_TIMES = f"""{POINTS}, v AS (SELECT user_id % 4 AS layer, user_id, start_ms - start_ms % {HOUR} AS hour_ms, CASE user_id % 4 WHEN 0 THEN start_ms % 60000 WHEN 3 THEN start_ms * 4096 ELSE start_ms END AS t FROM pts),
 f AS (SELECT layer, user_id, hour_ms, min(t) + (layer = 2)::INT AS start FROM v GROUP BY layer, user_id, hour_ms),
 w AS (SELECT v.*, start FROM v JOIN f USING (layer, user_id, hour_ms)),
 l AS (SELECT layer, min(t) AS low, max(t) - min(t) AS span, max(t - start) AS own, min(t - start) AS least FROM w GROUP BY layer),
 k AS (SELECT layer, low, CASE WHEN greatest((span + 65534) // 65535, 1) <= 100 THEN 'u16' WHEN least >= 0 AND own > 0 AND greatest((own + 65534) // 65535, 1) <= 100 THEN 'u16_own' WHEN greatest((span + 4294967294) // 4294967295, 1) <= 100 THEN 'u32' ELSE 'i64' END AS kind, span, own FROM l),
 s AS (SELECT *, CASE kind WHEN 'u16' THEN greatest((span + 65534) // 65535, 1) WHEN 'u16_own' THEN greatest((own + 65534) // 65535, 1) WHEN 'u32' THEN greatest((span + 4294967294) // 4294967295, 1) ELSE 1 END AS step FROM k)"""


@C.add("vertex_time_tiers", f"WITH {_TIMES} SELECT layer, user_id, hour_ms, kind, step::BIGINT AS step, sum((t - CASE kind WHEN 'i64' THEN 0 WHEN 'u16_own' THEN start ELSE low END) // step)::BIGINT AS total FROM w JOIN s USING (layer) GROUP BY ALL")
def vertex_time_tiers(spark, d):
    layer, ms = F.pmod("user_id", F.lit(4)), F.col("start_ms")
    t = F.when(layer == 0, ms % 60000).when(layer == 3, ms * 4096).otherwise(ms)
    lists = src.points(spark, d).select(layer.alias("layer"), "user_id", timing.bucket(ms, HOUR).alias("hour_ms"), t.alias("t")).groupBy("layer", "user_id", "hour_ms").agg(F.collect_list("t").alias("times"))
    begun = lists.withColumn("start", F.array_min("times") + (F.col("layer") == 2).cast("int"))
    return vertices.time_tiers(begun, "layer", "start", "times", 100).select("layer", "user_id", "hour_ms", "kind", "step", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_VALUES = "v AS (SELECT user_id % 4 AS layer, user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 5.0 ELSE value END AS x FROM events), g AS (SELECT layer, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 65534 ELSE 1 END AS step FROM v GROUP BY layer)"


@C.add("vertex_value_codes", f"WITH {_VALUES} SELECT layer, user_id, sum(CASE WHEN x IS NULL THEN 65535 ELSE floor((x - lo) / step + 0.5) END)::BIGINT AS total FROM v JOIN g USING (layer) GROUP BY ALL")
def vertex_value_codes(spark, d):
    layer = F.pmod("user_id", F.lit(4))
    x = F.when(F.col("event_id") % 7 == 0, None).when(layer == 0, 5.0).otherwise(F.col("value"))
    lists = src.table(spark, d, "events").select(layer.alias("layer"), "user_id", F.struct(x.alias("x")).alias("v")).groupBy("layer", "user_id").agg(F.collect_list("v").alias("v")).withColumn("values", F.col("v.x"))
    return vertices.value_codes(lists, "layer", "values").select("layer", "user_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"))


@C.add("voxel_thin", f"WITH {POINTS} SELECT min(feature_id) AS feature_id, arg_min(value, feature_id) AS value FROM pts GROUP BY floor(lon / 2.5), floor(lat / 2.5), floor(start_ms / {float(DAY)})")
def voxel_thin(spark, d):
    return vertices.voxel_thin(src.points(spark, d), {"lon": 2.5, "lat": 2.5, "start_ms": float(DAY)}, "feature_id").select("feature_id", "value")


@C.add("grid_samples", f"WITH {POINTS}, g AS (SELECT floor(lon / 5 + 0.5)::BIGINT AS i, floor(lat / 5 + 0.5)::BIGINT AS j, avg(value) AS node FROM pts GROUP BY ALL), c AS (SELECT feature_id, floor(lon / 5)::BIGINT + a AS i, floor(lat / 5)::BIGINT + b AS j, abs(1 - a - (lon / 5 - floor(lon / 5))) * abs(1 - b - (lat / 5 - floor(lat / 5))) AS w FROM pts, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)) SELECT feature_id, round(sum(w * node), 6) AS sample FROM c JOIN g USING (i, j) GROUP BY feature_id HAVING count(*) = 4")
def grid_samples(spark, d):
    p = src.points(spark, d)
    near = lambda c: F.floor(F.col(c) / 5.0 + 0.5)
    grid = p.groupBy(near("lon").alias("i"), near("lat").alias("j")).agg(F.avg("value").alias("node"))
    return vertices.sampled_grid(p, grid, 5.0).select("feature_id", F.round("sample", 6).alias("sample"))


_BOXES = f"{POINTS}, b AS (SELECT feature_id, start_ms - start_ms % {DAY} AS b, lon AS w, least(lon + (feature_id % 17) * 0.5 + 0.5, 180) AS e, lat AS s, lat + (feature_id % 11) * 0.5 + 0.5 AS n FROM pts)"


@C.add("clip_replication", f"WITH {_BOXES}, r AS (SELECT *, {x_sql(5, 'w')} AS x0, {x_sql(5, 'e')} AS x1, {y_sql(5, 'n')} AS y0, {y_sql(5, 's')} AS y1, {x_sql(5, '((w + e) / 2)')} AS cx, {y_sql(5, '((s + n) / 2)')} AS cy FROM b), c AS (SELECT b, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r), t AS (SELECT b, x, unnest(range(y0, y1 + 1)) AS y FROM c) SELECT round((SELECT count(*) FROM t) / (SELECT count(*) FROM r), 9) AS instances_per_feature, round((SELECT count(*) FROM (SELECT DISTINCT b, x, y FROM t)) / (SELECT count(*) FROM (SELECT DISTINCT b, cx, cy FROM r)), 9) AS cell_inflation")
def clip_replication(spark, d):
    lon, lat, i = F.col("lon"), F.col("lat"), F.col("feature_id")
    boxes = src.points(spark, d).select("start_ms", lon.alias("west"), F.least(lon + i % 17 * 0.5 + 0.5, F.lit(180.0)).alias("east"), lat.alias("south"), (lat + i % 11 * 0.5 + 0.5).alias("north"))
    return vertices.replication(boxes, 5, DAY).select(*[F.round(c, 9).alias(c) for c in ("instances_per_feature", "cell_inflation")])


@C.add("merged_moments", "SELECT event_type, count(value) AS n, count(*) - count(value) AS nulls, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def merged_moments(spark, d):
    p = src.points(spark, d).withColumn("day", timing.bucket(F.col("start_ms"), DAY))
    whole = vertices.merged_moments(vertices.moments(p, ["event_type", "day"], "value"), ["event_type"])
    return whole.select("event_type", "n", "nulls", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 6).alias("variance"), "low", "high")


@C.add("export_provenance", f"WITH {placed_sql(5)} SELECT zoom AS tile_zoom, x AS tile_x, y AS tile_y, feature_id, value FROM placed")
def export_provenance(spark, d):
    return vertices.provenance(tiling.place(src.points(spark, d), 5)).select("tile_zoom", "tile_x", "tile_y", "feature_id", "value")


@C.add("area_intervals", "SELECT n_name AS area, n_nationkey AS nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 GROUP BY ALL UNION ALL SELECT NULL, c_nationkey, count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY ALL")
def area_intervals(spark, d):
    spans = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nationkey"), "o_orderdate")
    areas = src.table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("area"))
    found, lost = vertices.with_areas(spans, areas, "nationkey")
    return found.groupBy("area", "nationkey").agg(F.count("*").alias("n")).unionByName(lost.withColumn("area", F.lit(None).cast("string")))


@C.add("base_tier", f"WITH {placed_sql(4, HOUR)} SELECT x, y, bucket_ms, count(*) AS n FROM placed GROUP BY ALL")
def base_tier(spark, d):
    base = tiling.index(tiling.place(src.points(spark, d), 4, HOUR)).select("x", "y", "bucket_ms", "n")
    return joins.rolled_up(base, ["x", "y"], [HOUR, 6 * HOUR, DAY]).where(F.col("width_ms") == HOUR).drop("width_ms")


@C.add("stride_sample", "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, value FROM r WHERE i % greatest(ceil(n / 300.0), 1) = 0")
def stride_sample(spark, d):
    return ordered.stride(src.table(spark, d, "events").select("event_id", "value"), 300, ["event_id"])


@C.add("lod_bucket_check", f"WITH c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {HOUR} ELSE {DAY} END AS stamped, o_custkey % 2 = 0 AS consumes FROM orders) SELECT o_orderkey, CASE WHEN stamped IS NULL AND consumes OR stamped IS NOT NULL AND NOT consumes THEN 'warn' WHEN consumes AND stamped <> {HOUR} THEN 'mismatch' ELSE 'ok' END AS verdict FROM c")
def lod_bucket_check(spark, d):
    k = F.col("o_orderkey") % 3
    stamped = F.when(k == 1, HOUR).when(k == 2, DAY)
    return src.table(spark, d, "orders").select("o_orderkey", checks.lod_bucket(stamped, F.col("o_custkey") % 2 == 0, HOUR).alias("verdict"))


@C.add("missing_capabilities", "SELECT DISTINCT c_nationkey AS nationkey, c_mktsegment AS segment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9500")
def missing_capabilities(spark, d):
    c = src.table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return checks.missing_capabilities(c, c.where("c_acctbal > 9500"), ["nationkey", "segment"])


@C.add("subset_by_state_and_time", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def subset_by_state_and_time(spark, d):
    o = src.table(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey", "o_orderstatus", "o_totalprice")
