"""Codes: ids and hashes of bytes, integer codes, clocks, text forms of boxes and sizes, log scales."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Bytes in a unit of size.
_SIZES = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def fnv1a_64(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: one step for each place, over the strings that reach it."""
    sizes = np.asarray([len(v) for v in values], np.int64)
    data, first = np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes
    out = np.full(len(values), FNV_START, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    for place in range(int(sizes.max(initial=0))):
        own = order[: np.searchsorted(-sizes[order], -place, "left")]
        out[own] = (out[own] ^ data[first[own] + place]) * np.uint64(FNV_PRIME)
    return out


@F.pandas_udf(T.LongType())
def fnv1a(value: pd.Series) -> pd.Series:
    """FNV-1a of a binary column, its 64 bits as a long; null stays."""
    known = value.notna().to_numpy()
    out = pd.Series(np.zeros(len(value), np.int64), dtype="Int64")
    out[known] = fnv1a_64([bytes(v) for v in value[known]]).view(np.int64)
    out[~known] = pd.NA
    return out


def big_endian(v: Column) -> Column:
    """The 8 bytes of a long."""
    return F.unhex(F.lpad(F.hex(v.cast("long")), 16, "0"))


def feature_id(source: Column | None, lon: Column, lat: Column, start_ms: Column) -> Column:
    """A feature's id: its source id if that is a number, else the FNV-1a of that text, else the FNV-1a of time and place.

    Places count to 1e-7 degrees, so that equal features get equal ids on every machine.
    """
    e7 = lambda c: F.round(c * 1e7).cast("long")
    place = fnv1a(F.concat(big_endian(start_ms), big_endian(e7(lon)), big_endian(e7(lat))))
    if source is None:
        return place
    text = source.cast("string")
    return F.coalesce(text.try_cast("long"), fnv1a(text.cast("binary")), place)


def zigzag(v: Column) -> Column:
    """Signed integers as unsigned ones, small ones staying small."""
    return F.shiftleft(v.cast("long"), 1).bitwiseXOR(F.shiftright(v.cast("long"), 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(1))


def varint_size(v: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(v), "^0+", "")) / 7)).cast("int")


def quoted(name: str) -> str:
    """An SQL identifier."""
    return '"' + name.replace('"', '""') + '"'


def box(text: str) -> tuple[float, float, float, float]:
    """``west,south,east,north``."""
    parts = tuple(float(p) for p in text.split(","))
    if len(parts) != 4 or parts[0] > parts[2] or parts[1] > parts[3]:
        raise ValueError(f"not a box: {text!r}")
    return parts


def size_bytes(text: str) -> int:
    """``250MiB``, ``1.5 GB``, ``4096``."""
    number = text.strip().rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ")
    unit = text.strip()[len(number) :].strip().lower()
    if unit not in _SIZES:
        raise ValueError(f"not a size: {text!r}")
    return int(float(number) * _SIZES[unit])


def clock_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` counted from a service day's start; hours may pass 24. Other texts are null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^(\d+):([0-5]\d):([0-5]\d)$", i).try_cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def service_start_ms(day: Column, zone: str) -> Column:
    """The start of a service day: twelve hours before its local noon, which is not midnight when clocks change."""
    noon = F.to_utc_timestamp(day.cast("date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"), zone)
    return F.unix_millis(noon) - 12 * 3_600_000


def fold_to_year(ms: Column, year: int) -> Column:
    """The same moment of a reference year; a leap day falls on the last of February."""
    t = F.timestamp_millis(ms)
    start = F.date_trunc("day", t)
    day = F.coalesce(F.try_make_timestamp(F.lit(year), F.month(t), F.dayofmonth(t), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(F.lit(year), F.lit(2), F.lit(28), F.lit(0), F.lit(0), F.lit(0)))
    return F.unix_millis(day) + ms - F.unix_millis(start)


def log_scaled(v: Column, low: Column | float, high: Column | float) -> Column:
    """0 to 1 by the logarithm between two bounds, kept inside."""
    low, high = (F.lit(x) if isinstance(x, float) else x for x in (low, high))
    share = (F.log10(F.greatest(v, low)) - F.log10(low)) / (F.log10(high) - F.log10(low))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def log_anomaly(v: Column, usual: Column, most: float = 3.0) -> Column:
    """Doublings above the usual value, within ``most`` either way."""
    return F.least(F.greatest(F.log2(v / usual), F.lit(-most)), F.lit(most))


def playback_seconds(range_ms: Column, width_ms: int) -> Column:
    """How long to play a range: the root of its buckets, between 20 and 90 seconds; null for less than two."""
    buckets = F.ceil(range_ms / width_ms)
    return F.when(buckets >= 2, F.least(F.greatest(F.round(F.sqrt(buckets)), F.lit(20)), F.lit(90))).cast("int")


def tile_relative(lon: Column, lat: Column, zoom: int, x: Column, y: Column, extent: int = 4096) -> tuple[Column, Column]:
    """Whole coordinates within a tile, not kept inside it."""
    n = 1 << zoom
    fx = (lon + 180) / 360 * n - x
    fy = (1 - F.asinh(F.tan(F.radians(lat))) / np.pi) / 2 * n - y
    return F.round(fx * extent).cast("int"), F.round(fy * extent).cast("int")


def of_tile_relative(px: Column, py: Column, zoom: int, x: Column, y: Column, extent: int = 4096) -> tuple[Column, Column]:
    n = 1 << zoom
    return (x + px / extent) / n * 360 - 180, F.degrees(F.atan(F.sinh(np.pi * (1 - 2 * (y + py / extent) / n))))
