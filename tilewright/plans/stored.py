"""Queries that write: archives and streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import functions as F

from tilewright.plans.base import DAY, HOUR, T0, Catalogue, placed_sql, x_sql, y_sql
from tilewright.sources import archive, packed
from tilewright.sources import features as src
from tilewright.streaming import windows

C = Catalogue()
_BOX = (-100.0, -30.0, 20.5, 42.0)
_WIN = (T0 + 5 * DAY, T0 + 9 * DAY)


def _folder(spark) -> str:
    """A new folder that all executors share; local only where the setting is absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/tilewright-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        return


def _archive(spark, d) -> str:
    root = _folder(spark)
    archive.write(src.points(spark, d), root, (2, 6), 6 * HOUR)
    return root


@C.add("archive_pruned_read", f"WITH {placed_sql(6)} SELECT feature_id, lon, lat, start_ms, value, x, y FROM placed WHERE lon BETWEEN -100 AND 20.5 AND lat BETWEEN -30 AND 42 AND end_ms >= {_WIN[0]} AND start_ms <= {_WIN[1]}")
def archive_pruned_read(spark, d):
    return archive.read(spark, _archive(spark, d), _BOX, _WIN).select("feature_id", "lon", "lat", "start_ms", "value", "x", "y")


@C.add("archive_directory", f"WITH {placed_sql(6, 6 * HOUR)} SELECT z AS zoom, {x_sql('z')} AS x, {y_sql('z')} AS y, bucket_ms, count(*) AS n, min(start_ms) AS cover_t_min, max(end_ms) AS time_end FROM placed, range(2, 7) t(z) GROUP BY ALL")
def archive_directory(spark, d):
    return archive.directory(spark, _archive(spark, d)).select("zoom", "x", "y", "bucket_ms", "n", "cover_t_min", "time_end")


@C.add("archive_checks", "SELECT unnest(['counts', 'totals', 'intervals', 'tight_times', 'buckets', 'placement', 'bounds', 'time_range', 'unique_tiles']) AS \"check\", 0::BIGINT AS offenders")
def archive_checks(spark, d):
    return archive.check(spark, _archive(spark, d))


@C.add("stream_tumbling", f"SELECT event_type, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % {6 * HOUR} AS start_ms, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = windows.drain(windows.tumbling(windows.stream(spark, d), "6 hours", ["event_type"]), _folder(spark), "complete")
    return out.select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")


@C.add("stream_sliding", f"SELECT event_type, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % {6 * HOUR} - k * {6 * HOUR} AS start_ms, count(*) AS n FROM events, range(0, 2) t(k) GROUP BY ALL")
def stream_sliding(spark, d):
    out = windows.drain(windows.sliding(windows.stream(spark, d), "12 hours", "6 hours", ["event_type"]), _folder(spark), "complete")
    return out.select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")


@C.add(
    "stream_sessions",
    f"""WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {12 * HOUR * 1000} THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS k FROM f) SELECT user_id, min(t) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, d):
    out = windows.drain(windows.sessions(windows.stream(spark, d), "12 hours", ["user_id"]), _folder(spark), "complete")
    return out.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")


@C.add("stream_throttle")
def stream_throttle(spark, d):
    return windows.drain(windows.throttle(windows.stream(spark, d), "user_id", 6 * HOUR), _folder(spark), "append")


@C.add("serve_from_archive", f"WITH {placed_sql(3, 6 * HOUR)} SELECT feature_id, value FROM placed WHERE x = 3 AND y = 3 AND bucket_ms = {T0 + 3 * DAY}")
def serve_from_archive(spark, d):
    return archive.tile(spark, _archive(spark, d), 3, 3, 3, T0 + 3 * DAY).select("feature_id", "value")




_COLUMNS = ["feature_id", "start_ms", "lon", "lat", "value"]


def _packed(spark, d) -> str:
    return packed.write(src.points(spark, d), _folder(spark), (2, 5), DAY, _COLUMNS, 100_000, 256)


@C.add("packed_viewport", f"WITH {placed_sql(5, DAY)} SELECT zoom, x, y, bucket_ms, feature_id, value FROM placed WHERE x BETWEEN 4 AND 12 AND y BETWEEN 8 AND 20 AND bucket_ms BETWEEN {T0 + 2 * DAY} AND {T0 + 5 * DAY}")
def packed_viewport(spark, d):
    p = src.points(spark, d)
    found = packed.read(spark, _packed(spark, d), p.select(*_COLUMNS).schema, 5, (4, 12), (8, 20), (T0 + 2 * DAY, T0 + 6 * DAY))
    return found.where(F.col("bucket_ms").between(T0 + 2 * DAY, T0 + 5 * DAY)).select("zoom", "x", "y", "bucket_ms", "feature_id", "value")


@C.add("packed_entries", f"WITH {placed_sql(5, DAY)} SELECT z AS zoom, {x_sql('z')} AS x, {y_sql('z')} AS y, bucket_ms, count(*) AS n, min(start_ms) AS cover_t_min, max(end_ms) AS time_end FROM placed, range(2, 6) t(z) GROUP BY ALL")
def packed_entries(spark, d):
    return packed.entries(spark, _packed(spark, d)).select("zoom", "x", "y", "bucket_ms", "n", "cover_t_min", "time_end")
