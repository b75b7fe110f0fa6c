"""Values: coercion, quantization, bands, percentiles by index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I32 = 2147483647


def finite(v: Column) -> Column:
    """Doubles without NaN and infinities (null instead)."""
    d = v.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def numeric_text(v: Column) -> Column:
    """The number that a text is, or null."""
    return finite(F.trim(v).try_cast("double"))


def at_index(values: Column, index: Column) -> Column:
    """Element of a sorted array by a 0-based index, kept inside."""
    return F.get(values, F.least(index, F.size(values) - 1).cast("int"))


def floor_percentile(v: Column, q: float) -> Column:
    """Aggregate: ``sorted[min(floor(n q), n - 1)]``."""
    values = F.array_sort(F.collect_list(v))
    return at_index(values, F.floor(F.size(values) * F.lit(q)))


def outward_2sf(v: Column, up: bool) -> Column:
    """Rounded outward to two significant figures; 0 stays."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - 1)
    steps = v / scale
    return F.when(v == 0, F.lit(0.0)).otherwise((F.ceil(steps - 1e-9) if up else F.floor(steps + 1e-9)) * scale)


def band(v: Column, edges: list[tuple[float, str]], above: str) -> Column:
    """The name of the first edge that v is below."""
    out = None
    for edge, name in edges:
        out = F.when(v < edge, name) if out is None else out.when(v < edge, name)
    return out.otherwise(above)


def quantized(v: Column, offset: Column | float, step: Column | float) -> Column:
    """Index on a grid; halves away from zero."""
    return F.round((v - offset) / step).cast("long")


def pin(v: Column) -> dict[str, Column]:
    """Aggregates that fix a column's grid: offset, step and stored kind, or a refusal."""
    v = finite(v)
    low, high, n = F.min(v), F.max(v), F.count(v)
    whole = F.coalesce(F.bool_and(v == F.floor(v)), F.lit(False))
    too_far = F.coalesce(F.max(F.abs(v)) >= I32, F.lit(False))
    span = high - low
    kind = (
        F.when(n == 0, "u16")
        .when(too_far, "refused")
        .when(whole & (span <= 65535), "u16")
        .when(whole & (span <= I32), "i32")
        .otherwise("u16")
    )
    step = F.when(n == 0, F.lit(1.0)).when(too_far, F.lit(None)).when((whole & (span <= I32)) | (span == 0), F.lit(1.0)).otherwise(span / 65535)
    return {"offset": F.when(n == 0, F.lit(0.0)).when(~too_far, low), "step": step, "kind": kind}


def vector(columns: list[Column], as_bytes: bool = False) -> Column:
    """Several numbers as one array; nulls are 0, bytes are rounded and kept in 0 to 255."""
    parts = [F.coalesce(finite(c), F.lit(0.0)) for c in columns]
    if as_bytes:
        return F.array(*[F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(255.0)).cast("int") for c in parts])
    return F.array(*[c.cast("float") for c in parts])


def normal_name(name: str) -> str:
    """A header in lower case, letters and digits only."""
    return "".join(c for c in name.lower() if c.isalnum())
