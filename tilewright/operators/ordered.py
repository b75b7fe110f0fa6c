"""Operators that depend on order: tracks, fills, throttles, dense ids, adaptive windows, samples."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import space
from tilewright.operators import ranges


def segments(features: DataFrame, key: str, gap_ms: int, least_points: int = 2, max_lon_step: float = 180.0) -> DataFrame:
    """Adds ``segment``: a new one begins after a gap longer than ``gap_ms`` or a jump across the date line; short ones go."""
    w = Window.partitionBy(key).orderBy("start_ms", "feature_id")
    before, lon = F.lag("start_ms").over(w), F.lag("lon").over(w)
    new = F.when(before.isNull() | (F.col("start_ms") - before > gap_ms) | (F.abs(F.col("lon") - lon) > max_lon_step), 1).otherwise(0)
    out = features.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(key, "segment"))).where(F.col("_n") >= least_points).drop("_n")


def segment_index(segmented: DataFrame, key: str) -> DataFrame:
    return segmented.groupBy(key, "segment").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def filled(features: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``filled``: the last known value, else the next one."""
    w = Window.partitionBy(key).orderBy("start_ms", "feature_id")
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return features.withColumn("filled", F.coalesce(back, ahead))


def _next(c: str, w) -> Column:
    return F.lead(c).over(w)


def bearings(features: DataFrame, key: str) -> DataFrame:
    """Adds ``bearing`` to the next point of the track; the last has none."""
    w = Window.partitionBy(key).orderBy("start_ms", "feature_id")
    return features.withColumn("bearing", space.bearing(F.col("lon"), F.col("lat"), _next("lon", w), _next("lat", w)))


def legs(features: DataFrame, key: str) -> DataFrame:
    """Adds ``leg_km`` from the point before; 0 at the first."""
    w = Window.partitionBy(key).orderBy("start_ms", "feature_id")
    return features.withColumn("leg_km", F.coalesce(space.haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0)))


def vertex_times(features: DataFrame, key: str) -> DataFrame:
    """Adds ``vertex_ms``: the track's time spread over its length, cut to whole milliseconds."""
    w = Window.partitionBy(key)
    run = w.orderBy("start_ms", "feature_id").rowsBetween(Window.unboundedPreceding, 0)
    t = legs(features, key).withColumns({"done_km": F.sum("leg_km").over(run), "all_km": F.sum("leg_km").over(w), "t0": F.min("start_ms").over(w), "t1": F.max("start_ms").over(w)})
    share = F.when(F.col("all_km") > 0, F.col("done_km") / F.col("all_km")).otherwise(0.0)
    return t.withColumn("vertex_ms", (F.col("t0") + (share * (F.col("t1") - F.col("t0"))).cast("long"))).drop("t0", "t1")


def dense_numbers(features: DataFrame, key: str) -> DataFrame:
    """``key, dense``: 0, 1, … by first appearance (start, key).

    Ranks are counted in two levels: ranges are numbered inside, and
    the sizes of those before (one row a range) are added, so no task sees
    all keys.
    """
    first = features.groupBy(key).agg(F.min("start_ms").alias("first_ms"))
    parted, _ = ranges.dealt(first, ["first_ms", key])
    nth = F.row_number().over(Window.partitionBy("_p").orderBy("first_ms", key)) - 1
    return parted.select(key, "first_ms", (F.col("_b") + nth).cast("long").alias("dense"))


def row_ids(placed: DataFrame, keys: tuple[str, ...] = ("zoom", "x", "y", "bucket_ms")) -> DataFrame:
    """Adds ``row_id``: the place in its tile by start time, ties by feature id."""
    return placed.withColumn("row_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms", "feature_id")) - 1).cast("long"))


def first_wins(features: DataFrame, key: str, slot_ms: int) -> DataFrame:
    """The first record of each key and time slot; a minimum by struct, so each task sends one candidate a group."""
    slot = F.col("start_ms") - F.pmod(F.col("start_ms"), F.lit(slot_ms))
    rest = [c for c in features.columns if c not in (key, "start_ms", "feature_id")]
    return features.groupBy(key, slot.alias("slot_ms")).agg(F.min(F.struct("start_ms", "feature_id", *rest)).alias("r")).select(key, "slot_ms", "r.*")


def throttle(features: DataFrame, key: str, least_ms: int) -> DataFrame:
    """Keeps a row if its key's last kept row is at least ``least_ms`` older. Sequential by nature: one key at a time."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "feature_id"])
        last, mask = None, []
        for t in pdf["start_ms"]:
            ok = last is None or t - last >= least_ms
            mask.append(ok)
            last = t if ok else last
        return pdf[np.asarray(mask, bool)]

    return features.groupBy(key).applyInPandas(keep, features.schema)


def split_windows(counts: list[int] | np.ndarray, target: int) -> list[int]:
    """Sizes of windows over atoms: as many as the greedy pass makes, with the smallest possible largest window.

    Returns for each window how many atoms it takes. Passes jump by sums, a window at a time, and the windows that
    the rest needs are counted once, from the end, so the work is that of a sort.
    """
    counts = np.asarray(counts, np.int64)
    upto, size = np.concatenate([[0], np.cumsum(counts)]), len(counts)
    ends = np.searchsorted(upto, upto[:-1] + target, "left")
    ends = np.maximum(ends, np.arange(size) + 1).tolist()
    k, at = 1, ends[0] if size else 0
    while at < size:
        k, at = k + 1, ends[at]

    def reach(cap: int) -> list[int]:
        """For each atom where a window that begins with it and holds ``cap`` rows ends."""
        return np.maximum(np.searchsorted(upto, upto[:-1] + cap, "right") - 1, np.arange(size) + 1).tolist()

    def needed(cap: int) -> int:
        used, at, sums = 0, 0, upto
        while at < size:
            used, at = used + 1, max(int(sums.searchsorted(sums[at] + cap, "right")) - 1, at + 1)
        return used

    low, high = int(counts.max()), int(counts.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= k else (mid + 1, high)
    after, tail = reach(low), [0] * (size + 1)  # tail: windows that the atoms from here on need
    for i in range(size - 1, -1, -1):
        tail[i] = tail[after[i]] + 1
    out, at, rest, sizes = [], 0, int(upto[-1]), counts.tolist()
    for left in range(k, 0, -1):
        if left == 1:
            out.append(size - at)
            break
        aim, total, start = min(-(-rest // left), low), 0, at
        while at < size - (left - 1):
            if at > start and (total + sizes[at] > low or total >= aim and tail[at] <= left - 1):
                break
            total += sizes[at]
            at += 1
        out.append(at - start)
        rest -= total
    return out


def adaptive_windows(placed: DataFrame, target: int, keys: tuple[str, ...] = ("zoom", "x", "y")) -> DataFrame:
    """``keys, window_start, n``: windows of about ``target`` rows that never part equal times.

    Only atoms (a time and its count) reach the sequential step, one tile at a time.
    """
    atoms = placed.groupBy(*keys, "start_ms").agg(F.count("*").alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms")
        sizes = split_windows(pdf["n"].to_numpy(), target)
        pdf["window"] = np.repeat(np.arange(len(sizes)), sizes)
        return pdf.groupby([*keys, "window"], as_index=False).agg(window_start=("start_ms", "first"), n=("n", "sum"))[[*keys, "window_start", "n"]]

    kinds = dict(atoms.dtypes)
    return atoms.groupBy(*keys).applyInPandas(cut, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", window_start long, n long")


def stratified(tiles: DataFrame, size: int, weight: str = "n", strata: tuple[str, ...] = ("zoom", "bucket_ms"), order: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """A sample of about ``size`` tiles, spread over strata by weight with largest remainders; each stratum gets one if there is room."""
    w = Window.partitionBy(*strata)
    by = tiles.groupBy(*strata).agg(F.count("*").alias("_k"), F.sum(weight).alias("_w"))
    every = Window.partitionBy()
    by = by.withColumns({"_all": F.sum("_w").over(every), "_s": F.count("*").over(every)})
    base = F.when(F.col("_s") <= size, 1).otherwise(0)
    share = (size - F.col("_s") * base) * F.col("_w") / F.col("_all")
    by = by.withColumn("_q", base + F.floor(share)).withColumn("_r", share - F.floor(share))
    left = F.lit(size) - F.sum("_q").over(every)
    by = by.withColumn("_q", F.least(F.col("_k"), F.col("_q") + F.when(F.row_number().over(Window.orderBy(F.col("_r").desc(), *strata)) <= left, 1).otherwise(0)))
    ranked = tiles.join(by.select(*strata, "_k", "_q"), list(strata)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    # Places floor(j k / q) for j = 0 … q - 1.
    j = F.ceil(F.col("_i") * F.col("_q") / F.col("_k"))
    return ranked.where((j < F.col("_q")) & (F.floor(j * F.col("_k") / F.col("_q")) == F.col("_i"))).drop("_k", "_q", "_i")


def stride(df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every ceil(n / most)-th row in order: rows are numbered within ranges, which then learn how many come before."""
    parted, n = ranges.dealt(df, order)
    step = max(1, -(-n // most))
    numbered = parted.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return numbered.where((F.col("_b") + F.col("_i")) % step == 0).select(*df.columns)


def resample(features: DataFrame, key: str, every_ms: int) -> DataFrame:
    """Points along each track at whole multiples of ``every_ms``, between neighbours."""
    w = Window.partitionBy(key).orderBy("start_ms", "feature_id")
    t = features.select(key, "start_ms", "lon", "lat", F.lead("start_ms").over(w).alias("t1"), F.lead("lon").over(w).alias("lon1"), F.lead("lat").over(w).alias("lat1"))
    first = F.ceil(F.col("start_ms") / every_ms).cast("long") * every_ms
    last = F.floor((F.col("t1") - 1) / every_ms).cast("long") * every_ms
    t = t.where(F.col("t1").isNotNull() & (first <= last)).withColumn("at_ms", F.explode(F.sequence(first, last, F.lit(every_ms))))
    f = (F.col("at_ms") - F.col("start_ms")) / (F.col("t1") - F.col("start_ms"))
    return t.select(key, "at_ms", (F.col("lon") + f * (F.col("lon1") - F.col("lon"))).alias("lon"), (F.col("lat") + f * (F.col("lat1") - F.col("lat"))).alias("lat"))


def clusters(places: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Greedy merge of weighted places, heaviest first: a seed takes all unvisited within the radius; weighted centre."""
    xy, weight = places[["x", "y"]].to_numpy(), places["weight"].to_numpy()
    free, out = np.ones(len(xy), bool), []
    for i in np.lexsort((np.arange(len(xy)), -weight)):
        if free[i]:
            near = free & (((xy - xy[i]) ** 2).sum(1) <= radius * radius)
            free &= ~near
            out.append((*(xy[near] * weight[near, None]).sum(0) / weight[near].sum(), weight[near].sum(), int(near.sum())))
    return pd.DataFrame(out, columns=["x", "y", "weight", "members"])


