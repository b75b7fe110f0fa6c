"""Profiles of a feature set: column statistics, histograms, style hints, coverage, density, times.

Each is one or two levels of grouping; what a second level reads is already
summed by tile, day or value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import timing, values
from tilewright.operators import ranges, tiling

DAY = 86_400_000
MAX_CATEGORIES, MAX_DICTIONARY_BYTES = 1024, 4096
#: The ladder of bucket widths.
WIDTHS = ("1s", "1m", "5m", "10m", "15m", "30m", "1h", "2h", "4h", "6h", "12h", "1d", "1w", "30d")


def extent(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("lon", "lat") for k, f in (("min", F.min), ("max", F.max))], F.min("start_ms").alias("min_start_ms"), F.max("end_ms").alias("max_end_ms"))


def column_stats(features: DataFrame, column: str) -> DataFrame:
    v = values.finite(F.col(column))
    return features.agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.abs(v)).alias("max_abs"), F.bool_and(v == F.floor(v)).alias("all_integer"), F.count(v).alias("finite"), (F.count("*") - F.count(v)).alias("nulls"), F.count_distinct(v).alias("n_distinct")
    )


def pins(features: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: offset, step and stored kind of its grid. One scan, however many columns."""
    found = features.agg(*[F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in values.pin(F.col(c)).items()]).alias(f"_{i}") for i, c in enumerate(columns)])
    return found.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def dictionary_verdict(features: DataFrame, column: str, overhead: int = 256) -> DataFrame:
    """Whether a dictionary is smaller than plain text, and within its caps."""
    by_value = features.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).withColumn("size", F.octet_length("v"))
    rows, k = F.sum("n"), F.count("*")
    plain = F.sum(F.col("size") * F.col("n")) + 4 * (rows + 1)
    own = F.sum("size")
    as_dict = own + 4 * (k + 1) + 2 * rows + overhead
    return by_value.agg(k.alias("categories"), plain.alias("plain_bytes"), as_dict.alias("dictionary_bytes"), ((as_dict < plain) & (k <= MAX_CATEGORIES) & (own <= MAX_DICTIONARY_BYTES)).alias("dictionary"))


def time_histogram(features: DataFrame, bins: int) -> DataFrame:
    """``bin, n, edge``: fixed-width bins from the first to the last start."""
    ends = features.agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    each = features.select("start_ms").crossJoin(F.broadcast(ends))  # one row
    span = F.col("hi") - F.col("lo") + 1
    nth = F.floor((F.col("start_ms") - F.col("lo")) * bins / span)
    return each.groupBy(nth.cast("long").alias("bin"), "lo", span.alias("span")).agg(F.count("*").alias("n")).select("bin", "n", (F.col("lo") + F.floor(F.col("bin") * F.col("span") / bins)).cast("long").alias("edge"))


def time_quantiles(features: DataFrame, bins: int, quantiles: list[float]) -> DataFrame:
    """Lower edge of the first bin whose running count reaches each quantile."""
    h = time_histogram(features, bins).withColumn("upto", F.sum("n").over(Window.orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    # The histogram has at most `bins` rows.
    want = [F.struct(F.lit(q).alias("q"), F.greatest(F.lit(1), F.least(F.ceil(F.lit(q) * F.col("total")), F.col("total"))).alias("target")) for q in quantiles]
    return h.withColumn("w", F.explode(F.array(*want))).where(F.col("upto") >= F.col("w.target")).groupBy(F.col("w.q").alias("q")).agg(F.min("edge").alias("boundary"))


def running_counts(counted: DataFrame, value: str = "v", n: str = "n") -> DataFrame:
    """Adds ``upto``, the sum of ``n`` over all values up to a row's, and ``total``.

    Ranges are summed inside, then the sums of those before (one row a range) are added, so no task sees all values.
    """
    parted, total = ranges.dealt(counted, [value], n)
    inside = parted.withColumn("_u", F.sum(n).over(Window.partitionBy("_p").orderBy(value)))
    return inside.withColumns({"upto": F.col("_b") + F.col("_u"), "total": F.lit(total).cast("long")}).drop("_p", "_u", "_b")


def style_numeric(features: DataFrame, column: str) -> DataFrame:
    """Extremes, floor-index percentiles and a domain rounded outward to two figures."""
    v = values.finite(F.col(column))
    counts = running_counts(features.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * F.lit(q)), F.col("total") - 1), F.col("v")))
    s = counts.agg(F.min("v").alias("low"), *[at(q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.97, 0.99)], F.max("v").alias("high"))
    return s.withColumn("domain_low", values.outward_2sf(F.col("low"), False)).withColumn("domain_high", values.outward_2sf(F.col("p97"), True))


def style_categorical(features: DataFrame, column: str) -> DataFrame:
    return features.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))


def heatmap(features: DataFrame, column: str, by: str, served: bool = False, classes: int = 8) -> DataFrame:
    """Low and 95th percentile by class, for the first classes in order. Served ones interpolate, offline ones index."""
    v = values.finite(F.col(column))
    rows = features.select(F.col(by).alias("class"), v.alias("v")).where("class IS NOT NULL AND v IS NOT NULL")
    if served:
        found = rows.groupBy("class").agg(F.min("v").alias("low"), F.percentile("v", F.lit(0.95)).alias("high"))
    else:
        w = Window.partitionBy("class")
        counts = rows.groupBy("class", "v").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(w.orderBy("v")), "total": F.sum("n").over(w)})
        found = counts.groupBy("class").agg(F.min("v").alias("low"), F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col("v"))).alias("high"))
    return found.orderBy("class").limit(classes)


def fingerprint(features: DataFrame, id_col: str = "feature_id", sketch: bool = False) -> DataFrame:
    """What a dataset must still say after a rebuild: extent, ranges, distinct ids (exact, or a sketch of 2**14 registers)."""
    ids = F.hll_sketch_estimate(F.hll_sketch_agg(id_col, F.lit(14))) if sketch else F.count_distinct(id_col)
    return features.agg(F.count("*").alias("n"), ids.alias("n_ids"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.min("start_ms").alias("t_min"), F.max("end_ms").alias("t_max"))


def coverage(features: DataFrame, low: int, high: int) -> DataFrame:
    """By zoom: occupied tiles, share of all tiles, and features per tile (upper median)."""
    h = tiling.tile_counts(features, low, high).groupBy("zoom", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("zoom")  # rows are distinct counts of a zoom
    h = h.withColumns({"total": F.sum("k").over(w), "upto": F.sum("k").over(w.orderBy("n"))})
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n")))
    return h.groupBy("zoom").agg(F.sum("k").alias("tiles"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("avg_n"), F.max("n").alias("max_n"), median.alias("median_n")).withColumn("share", F.col("tiles") / F.pow(F.lit(4.0), "zoom"))


def hotspots(features: DataFrame, degrees: float = 10.0, least: int = 100, top: int = 10) -> DataFrame:
    """Grid cells with more than twice the mean count, the largest first, ties by cell."""
    g = features.groupBy(F.floor(F.col("lon") / degrees).cast("long").alias("gx"), F.floor(F.col("lat") / degrees).cast("long").alias("gy")).agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    mean = F.avg("n").over(Window.partitionBy())  # at most 36 x 18 cells
    return g.withColumn("_m", mean).where((F.col("n") > 2 * F.col("_m")) & (F.col("n") > least)).drop("_m").orderBy(F.col("n").desc(), "gx", "gy").limit(top)


def density(features: DataFrame, zooms: tuple[int, int], width_ms: int, over: int = 10_000, under: int = 10) -> DataFrame:
    """By zoom, over tiles and buckets: mean, upper median, 95th percentile, maximum, share of the fullest hundredth."""
    low, high = zooms
    deep = tiling.place(features, high, width_ms).groupBy("x", "y", "bucket_ms").agg(F.count("*").alias("n"))
    # Counts rise through the zooms by shifts, not features.
    up = deep.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    shifted = [F.call_function("shiftright", F.col(c), F.lit(high) - F.col("zoom")).alias(c) for c in "xy"]
    t = up.select("zoom", *shifted, "bucket_ms", "n").groupBy("zoom", "x", "y", "bucket_ms").agg(F.sum("n").alias("n"))
    # A histogram of counts keeps the second level small: rows by (zoom, n).
    h = t.groupBy("zoom", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("zoom")
    h = h.withColumns({"total": F.sum("k").over(w), "upto": F.sum("k").over(w.orderBy("n")), "above": F.sum("k").over(w.orderBy(F.col("n").desc()))})
    top = F.greatest(F.lit(1), F.ceil(F.col("total") * 0.01))
    in_top = F.greatest(F.lit(0), F.least(F.col("k"), top - (F.col("above") - F.col("k"))))
    first = lambda target: F.min(F.when(F.col("upto") >= target, F.col("n")))
    return h.groupBy("zoom").agg(
        F.sum("k").alias("tiles"),
        (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("avg_n"),
        first(F.floor(F.col("total") / 2) + 1).alias("median_n"),
        first(F.ceil(F.col("total") * 0.95)).alias("p95_n"),
        F.max("n").alias("max_n"),
        (F.sum(in_top * F.col("n")) / F.sum(F.col("n") * F.col("k"))).alias("top_share"),
        F.sum(F.when(F.col("n") > over, F.col("k")).otherwise(0)).alias("oversized"),
        F.sum(F.when(F.col("n") < under, F.col("k")).otherwise(0)).alias("undersized"),
    )


def calendar(features: DataFrame) -> DataFrame:
    """Counts by hour, weekday (Sunday 0) and month (January 0): one pass over hours, then summed."""
    t = F.timestamp_millis(F.col("start_ms"))
    h = features.groupBy(F.hour(t).alias("h"), (F.dayofweek(t) - 1).alias("d"), (F.month(t) - 1).alias("m")).agg(F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("at")) for k, c in (("hour", "h"), ("month", "m"), ("weekday", "d"))])
    return h.select(F.explode(kinds).alias("k"), "n").groupBy("k.kind", "k.at").agg(F.sum("n").alias("n"))


def per_day(features: DataFrame) -> DataFrame:
    """Counts by day over days with any: extremes, mean, upper median, population deviation."""
    d = features.groupBy(timing.bucket(F.col("start_ms"), DAY).alias("day")).agg(F.count("*").alias("n"))
    m = F.array_sort(F.collect_list("n"))
    return d.agg(F.count("*").alias("days"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.get(m, F.floor(F.size(m) / 2).cast("int")).alias("median"), F.stddev_pop("n").alias("deviation"))


def temporal_class(features: DataFrame) -> DataFrame:
    """One row: ``kind`` of the distribution over time, and what it rests on."""
    t = features.agg(F.count("*").alias("n"), (F.max("start_ms") - F.min("start_ms")).alias("duration"), F.count_distinct("start_ms").alias("stamps"))
    d, hours = per_day(features), features.groupBy(F.hour(F.timestamp_millis(F.col("start_ms"))).alias("h")).agg(F.count("*").alias("n"))
    hv = hours.agg(((F.max("n") - F.when(F.count("*") == 24, F.min("n")).otherwise(0)) / (F.sum("n") / 24)).alias("variation"))
    one = t.crossJoin(d.select("mean", "deviation")).crossJoin(hv)  # one row each
    kind = (
        F.when(F.col("duration") < DAY, "Instantaneous")
        .when((F.col("stamps") < 100) & (F.col("duration") > 30 * DAY), "Sparse")
        .when(F.col("deviation") > 1.5 * F.col("mean"), "Bursty")
        .when(F.col("variation") > 2, "Periodic")
        .otherwise("Uniform")
    )
    return one.select("n", "duration", "stamps", kind.alias("kind"))


def bucket_recommendation(features: DataFrame) -> DataFrame:
    """``kind, target, width_ms``: the first width of the ladder that keeps the number of buckets within its target."""
    factor = F.when(F.col("kind") == "Bursty", 1.5).when(F.col("kind") == "Sparse", 0.5).otherwise(1.0)
    target = F.least(F.round(1350 * factor), F.col("stamps"), F.greatest(F.lit(1), F.floor(F.col("n") / 10))).cast("long")
    width: Column | None = None
    for w in WIDTHS:
        ms = timing.duration_ms(w)
        fits = F.floor(F.col("duration") / ms) <= F.col("target")
        width = F.when(fits, ms) if width is None else width.when(fits, ms)
    return temporal_class(features).withColumn("target", target).select("kind", "target", width.otherwise(timing.duration_ms("30d")).cast("long").alias("width_ms"))


def max_zoom(features: DataFrame) -> DataFrame:
    """The zoom at which a tile side matches the mean spacing of points."""
    c = 40075016.686
    e = features.agg(F.count("*").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("t"))
    phi = F.radians((F.col("s") + F.col("t")) / 2)
    floor_m = c / 2**18
    wide = F.greatest((F.col("e") - F.col("w")) / 360 * c * F.cos(phi), F.lit(floor_m))
    tall = F.greatest((F.col("t") - F.col("s")) / 360 * c, F.lit(floor_m))
    z = F.round(F.log2(c * F.cos(phi) / F.sqrt(wide * tall / F.col("n"))))
    return e.select("n", F.when(F.col("n") < 2, F.lit(0)).otherwise(F.least(F.greatest(z, F.lit(0)), F.lit(18))).cast("long").alias("max_zoom"))


def read_amplification(tiles: DataFrame, width_ms: int, window_ms: int, size: str = "n") -> DataFrame:
    """Windows that touch each tile, weighted by size; ``trailing`` are those beyond its own bucket."""
    t0 = tiles.agg(F.min("cover_t_min").alias("t0"))
    t = tiles.crossJoin(F.broadcast(t0))  # one row
    first, last = F.floor((F.col("cover_t_min") - F.col("t0")) / window_ms), F.floor((F.col("time_end") - F.col("t0")) / window_ms)
    tail = F.greatest(F.floor((F.col("bucket_ms") + width_ms - F.col("t0")) / window_ms), first)
    hits = last - first + 1
    trailing = F.greatest(last - tail + 1, F.lit(0))
    spill = F.least(F.floor(F.greatest(F.lit(0), F.col("time_end") - F.col("bucket_ms") - width_ms) / window_ms), F.lit(15))
    return t.groupBy(spill.cast("long").alias("residual")).agg(F.count("*").alias("tiles"), F.sum(hits * F.col(size)).cast("long").alias("hit_size"), F.sum(trailing * F.col(size)).cast("long").alias("trailing_size"))


def inspect(tiles: DataFrame, size: str = "n", blob: str | None = None) -> DataFrame:
    """By zoom: entries, distinct blobs, sizes, distinct buckets."""
    return tiles.groupBy("zoom").agg(F.count("*").alias("entries"), F.count_distinct(blob or size).alias("blobs"), F.sum(size).alias("total"), F.max(size).alias("largest"), F.avg(size).alias("mean"), F.count_distinct("bucket_ms").alias("buckets"))


def diff(before: DataFrame, after: DataFrame, key: str = "zoom", value: str = "n") -> DataFrame:
    """Full outer comparison of two profiles."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("change"))
