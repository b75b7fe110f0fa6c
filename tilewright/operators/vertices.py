"""Operators on vertex lists, grids of places and mergeable statistics; all are expressions and one or two groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import space, timing

#: The largest code of a vertex value, and the code of a missing one.
VALUE_MOST, VALUE_MISSING = 65534, 65535
#: The largest deltas of the two narrow kinds of vertex times.
U16, U32 = 65535, 4294967295


def time_tiers(features: DataFrame, layer: str, start: str, times: str, most_step_ms: int) -> DataFrame:
    """Adds ``kind, origin, step`` and ``codes``: vertex times as whole steps from an origin, in the narrowest kind whose step is at most ``most_step_ms``.

    ``u16`` counts from the layer's first time, ``u16_own`` from each feature's
    start, ``u32`` from the layer's first time; ``i64`` keeps the times. Lists
    without a time have null codes and do not count for their layer.
    """
    low, high, begin = F.array_min(times), F.array_max(times), F.col(start)
    wide = features.groupBy(layer).agg(
        F.min(low).alias("_low"), (F.max(high) - F.min(low)).alias("_span"),
        F.max(high - begin).alias("_own"), F.coalesce(F.bool_and(F.coalesce(low >= begin, low.isNull())), F.lit(False)).alias("_after"),
    )
    step = lambda span, most: f"greatest(({span} + {most - 1}) div {most}, 1)"
    fits = lambda span, most: F.expr(f"{step(span, most)} <= {most_step_ms}")
    kind = F.when(F.col("_span").isNull(), "i64").when(fits("_span", U16), "u16").when(F.col("_after") & (F.col("_own") > 0) & fits("_own", U16), "u16_own").when(fits("_span", U32), "u32").otherwise("i64")
    tiers = wide.withColumn("kind", kind).withColumn("step", F.expr(f"CASE kind WHEN 'u16' THEN {step('_span', U16)} WHEN 'u16_own' THEN {step('_own', U16)} WHEN 'u32' THEN {step('_span', U32)} ELSE 1 END"))
    origin = F.when(F.col("kind") == "i64", F.lit(0)).when(F.col("kind") == "u16_own", begin).otherwise(F.col("_low")).cast("long")
    codes = F.when(F.size(times) > 0, F.expr(f"transform({times}, t -> (t - origin) div step)"))
    return features.join(tiers.select(layer, "_low", "kind", "step"), layer).withColumn("origin", origin).withColumn("codes", codes).drop("_low")


def value_codes(features: DataFrame, layer: str, values: str) -> DataFrame:
    """Adds ``offset, step`` and ``codes``: vertex values on their layer's grid of 65535 points, missing ones as ``VALUE_MISSING``."""
    known = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    low, high = F.min(F.array_min(known)), F.max(F.array_max(known))
    step = (high - low) / VALUE_MOST
    grid = features.groupBy(layer).agg(F.coalesce(low, F.lit(0.0)).alias("offset"), F.when(step > 0, step).otherwise(1.0).alias("step"))

    def code(v: Column) -> Column:
        at = F.floor((v - F.col("offset")) / F.col("step") + 0.5)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(VALUE_MISSING)).otherwise(F.greatest(F.least(at, F.lit(VALUE_MOST)), F.lit(0))).cast("int")

    return features.join(grid, layer).withColumn("codes", F.transform(values, code))


def voxel_thin(points: DataFrame, sizes: dict[str, float], order: str) -> DataFrame:
    """One real point of each voxel, the first by ``order``; points without a place in every dimension go."""
    cells = [F.floor(F.col(c) / size).alias(f"_{c}") for c, size in sizes.items()]
    known = points.dropna(subset=list(sizes))
    return known.groupBy(*cells).agg(F.min_by(F.struct(*points.columns), order).alias("p")).select("p.*")


def sampled_grid(points: DataFrame, grid: DataFrame, cell_deg: float) -> DataFrame:
    """``feature_id, sample``: values between the four grid nodes ``i, j, node`` around each point; points that lack a node go."""
    gx, gy = F.col("lon") / cell_deg, F.col("lat") / cell_deg
    at = points.select("feature_id", F.floor(gx).alias("_i"), F.floor(gy).alias("_j"), (gx - F.floor(gx)).alias("_fx"), (gy - F.floor(gy)).alias("_fy"))
    fx, fy = F.col("_fx"), F.col("_fy")
    corners = F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a in (0, 1) for b in (0, 1)])
    found = at.select("feature_id", F.inline(corners)).join(grid, ["i", "j"])
    return found.groupBy("feature_id").agg(F.count("*").alias("_n"), F.sum(F.col("w") * F.col("node")).alias("sample")).where("_n = 4").drop("_n")


def replication(boxes: DataFrame, zoom: int, width_ms: int) -> DataFrame:
    """One row: tiles each box ``west, south, east, north`` covers on average, and covered tiles by bucket for each such tile of a centre."""
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    across = F.sequence(space.tile_x(F.col("west"), zoom), space.tile_x(F.col("east"), zoom))
    down = F.sequence(space.tile_y(F.col("north"), zoom), space.tile_y(F.col("south"), zoom))
    tiles = F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(x.alias("x"), y.alias("y"), F.lit(0).alias("centre")))))
    own = F.array(F.struct(space.tile_x(lon, zoom).alias("x"), space.tile_y(lat, zoom).alias("y"), F.lit(1).alias("centre")))
    each = boxes.select(timing.bucket(F.col("start_ms"), width_ms).alias("b"), F.inline(F.concat(tiles, own)))
    cells = each.groupBy("x", "y", "b").agg(F.sum("centre").alias("centres"), F.sum(1 - F.col("centre")).alias("covers"))
    total = cells.agg(F.sum("covers").alias("instances"), F.sum("centres").alias("n"), F.sum((F.col("covers") > 0).cast("long")).alias("covered"), F.sum((F.col("centres") > 0).cast("long")).alias("centred"))
    per = F.greatest(F.col("instances") / F.col("n"), F.lit(1.0))
    return total.select(F.coalesce(per, F.lit(1.0)).alias("instances_per_feature"), F.coalesce(F.least(F.greatest(F.col("covered") / F.col("centred"), F.lit(1.0)), per), F.lit(1.0)).alias("cell_inflation"))


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, nulls, mean, m2, low, high``: a statistic that ``merged_moments`` adds up."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The same statistic over all parts of a key; squares are taken about the common mean, so nothing cancels."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    at = parts.withColumn("_mean", F.when(F.sum("n").over(w) > 0, mean))
    return at.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))


def provenance(placed: DataFrame, names: tuple[str, str, str] = ("tile_zoom", "tile_x", "tile_y")) -> DataFrame:
    """Rows with their tile's address first; a property of one of its names is an error."""
    clash = [n for n in names if n in placed.columns]
    if clash:
        raise ValueError(f"properties already named {clash}")
    return placed.select(*[F.col(c).alias(n) for c, n in zip(("zoom", "x", "y"), names, strict=True)], *[c for c in placed.columns if c not in ("zoom", "x", "y")])


def with_areas(intervals: DataFrame, areas: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Intervals with their area's columns, and the keys that no area has with their counts."""
    lost = intervals.join(areas, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return intervals.join(areas, key), lost
