"""Checks on tiles and schemas; each gives the rows that offend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column_name, change``: columns that were added, removed or retyped."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    rows = [(c, "removed") for c in a.keys() - b.keys()] + [(c, "added") for c in b.keys() - a.keys()] + [(c, "retyped") for c in a.keys() & b.keys() if a[c] != b[c]]
    return before.sparkSession.createDataFrame(sorted(rows), "column_name string, change string")


def out_of_bucket(features: DataFrame, width_ms: int) -> DataFrame:
    """Features that start outside their bucket."""
    return features.where((F.col("start_ms") < F.col("bucket_ms")) | (F.col("start_ms") >= F.col("bucket_ms") + width_ms))


def backwards(features: DataFrame) -> DataFrame:
    return features.where(F.col("end_ms") < F.col("start_ms"))


def outside(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = box
    return features.where((F.col("lon") < west) | (F.col("lon") > east) | (F.col("lat") < south) | (F.col("lat") > north))


def count_mismatches(directory: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles whose declared count differs from the rows found, missing ones included."""
    found = decoded.groupBy(*keys).agg(F.count("*").alias("found"))
    return directory.select(*keys, F.col("n").alias("declared")).join(found, keys, "full_outer").where(~F.col("declared").eqNullSafe(F.col("found")))


def lod_bucket(stamped: Column, consumes: Column, width_ms: int) -> Column:
    """``ok``, ``warn`` or ``mismatch``: whether the bucket that zoom floors were made for is this build's.

    ``stamped`` is the bucket an input declares, or null; ``consumes`` whether the build reads its floors.
    """
    return F.when(stamped.isNotNull() & consumes, F.when(stamped == width_ms, "ok").otherwise("mismatch")).when(stamped.isNull() & ~consumes, "ok").otherwise("warn")


def missing_capabilities(required: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """What is required but not declared; empty if the declaration holds."""
    return required.select(*keys).distinct().join(declared.select(*keys), keys, "left_anti")
