"""Shared SQL of the oracles: the derived point features and tile arithmetic."""

from __future__ import annotations

from collections.abc import Callable

HOUR = 3_600_000
DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01, the first day of the events

POINTS = """pts AS (
  SELECT event_id AS feature_id, user_id, event_type, value, (-180 + ((user_id * 7919) % 24) * 15.0::DOUBLE) + ((event_id * 31) % 500) / 100.0::DOUBLE AS lon,
         (-60 + ((user_id * 104729) % 9) * 13.0::DOUBLE) + ((event_id * 17) % 400) / 100.0::DOUBLE AS lat,
         epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 AS end_ms
  FROM events)"""

SPANS = """spans AS (
  SELECT l_orderkey, l_linenumber, o_custkey, l_suppkey, epoch_us(o_orderdate) // 1000 AS raw_start, epoch_us(l_shipdate) // 1000 AS raw_end,
         least(epoch_us(o_orderdate) // 1000, epoch_us(l_shipdate) // 1000) AS start_ms, greatest(epoch_us(o_orderdate) // 1000, epoch_us(l_shipdate) // 1000) AS end_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def x_sql(zoom: int | str, lon: str = "lon") -> str:
    n = 1 << zoom if isinstance(zoom, int) else f"(1 << {zoom})"
    return f"least(CAST(floor(({lon} + 180) / 360 * {n}) AS BIGINT), {n} - 1)"


def y_sql(zoom: int | str, lat: str = "lat") -> str:
    n = 1 << zoom if isinstance(zoom, int) else f"(1 << {zoom})"
    return f"greatest(least(CAST(floor((1 - asinh(tan(radians(least(greatest({lat}, -85.05112877980659), 85.05112877980659)))) / pi()) / 2 * {n}) AS BIGINT), {n} - 1), 0)"


def placed_sql(zoom: int, width: int | None = None) -> str:
    b = f", start_ms - start_ms % {width} AS bucket_ms" if width else ""
    return f"{POINTS}, placed AS (SELECT *, {zoom} AS zoom, {x_sql(zoom)} AS x, {y_sql(zoom)} AS y{b} FROM pts)"


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
