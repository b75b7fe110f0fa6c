"""Times in Unix milliseconds UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_PER_SECOND = {"s": 1, "ms": 1000, "us": 1_000_000, "ns": 1_000_000_000}


def duration_ms(text: str) -> int:
    """``500ms``, ``90s``, ``30m``, ``1h``, ``1d``, ``1w``; a month is 30 days by convention of its user."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def duration_text(ms: int) -> str:
    """The shortest exact form."""
    for unit in ("d", "h", "m", "s"):
        if ms and ms % _UNITS[unit] == 0:
            return f"{ms // _UNITS[unit]}{unit}"
    return f"{ms}ms"


def bucket(ms: Column, width: int) -> Column:
    """Start of the half-open bucket, counted from the epoch; width 0 counts as 1."""
    width = max(1, width)
    return (ms - F.pmod(ms, F.lit(width).cast("long"))).cast("long")


def to_ms(value: Column, unit: str = "ms") -> Column:
    """Epoch numbers in ``unit`` as milliseconds; finer units are cut off."""
    per = _PER_SECOND[unit]
    whole = value.cast("long")
    if per <= 1000:
        return whole * (1000 // per)
    step = F.lit(per // 1000).cast("long")
    return ((whole - F.pmod(whole, step)) / step).cast("long")


def of_timestamp(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def parse_iso8601(text: Column) -> Column:
    """Milliseconds, or null: ``T`` or a space between date and time, fractions, ``Z``, a bare date; no zone means UTC."""
    return F.unix_millis(F.try_to_timestamp(F.trim(text)))


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def overlaps(start: Column, end: Column, low: int, high: int) -> Column:
    """Closed intervals that meet."""
    return (end >= low) & (start <= high)


def align_start(ms: int, width: int, tiers: tuple[int, ...] = ()) -> int:
    """A range's start moved back to its coarsest bucket."""
    widest = max((width, *tiers))
    return ms // widest * widest
