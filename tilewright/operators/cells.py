"""The summary tier: Quadbin cells with counts and aggregates, optionally by sub-bucket."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import space, timing, values

FINER = 3
DEEPEST = 26
AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    """``count,value:mean,…`` as (column, aggregate)."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(?:(\w+):)?(\w+)", part)
        if not m or (m[2] != "count" and (not m[1] or m[2] not in AGGREGATES)):
            raise ValueError(f"not an aggregate: {part!r}")
        out.append((m[1] or "", m[2]))
    return out


def summary(placed: DataFrame, zoom: int, width_ms: int, spec: str = "count", parts: int = 0) -> DataFrame:
    """By tile, bucket and cell: counts and aggregates of finite values (null if there is none), named ``agg_column``.

    ``parts`` splits the bucket into as many columns ``bucket_i`` of counts.
    """
    cell_zoom = min(zoom + FINER, DEEPEST)
    cell = space.quadbin(space.tile_x(F.col("lon"), cell_zoom), space.tile_y(F.col("lat"), cell_zoom), cell_zoom)
    aggs: list[Column] = [F.count("*").alias("n")]
    for column, how in parse_spec(spec):
        if how != "count":
            aggs.append(AGGREGATES[how](values.finite(F.col(column))).alias(f"{how}_{column}"))
    if parts:
        step = width_ms // parts
        nth = F.least(F.floor((F.col("start_ms") - F.col("bucket_ms")) / step), F.lit(parts - 1))
        aggs += [F.sum(F.when(nth == i, 1).otherwise(0)).alias(f"bucket_{i}") for i in range(parts)]
    return placed.withColumn("bucket_ms", timing.bucket(F.col("start_ms"), width_ms)).groupBy("zoom", "x", "y", "bucket_ms", cell.alias("cell")).agg(*aggs)


def centroid(cell: Column) -> tuple[Column, Column]:
    zoom, x, y = space.quadbin_parts(cell)
    return space.lon_of(x + 0.5, zoom), space.lat_of(y + 0.5, zoom)


def is_cell(cell: Column, zoom: int) -> Column:
    """A well-formed Quadbin of this zoom: header, zoom and filled low bits."""
    free = 52 - 2 * zoom
    low = (1 << free) - 1
    return (F.shiftright(cell, 52) == (space.QUADBIN_HEADER >> 52 | zoom)) & (cell.bitwiseAND(low) == low)
