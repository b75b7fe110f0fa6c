"""Web Mercator tiles, cells, curves and distances as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Web Mercator square and of the sphere.
MAX_LAT = 85.05112877980659
EARTH_KM = 6371.0
EARTH_M_PER_PIXEL = 156543.03392804
QUADBIN_HEADER = 0x4800000000000000


def valid(lon: Column, lat: Column) -> Column:
    """Coordinates that can be placed: finite, and longitude within ±180."""
    return lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & (F.abs(lat) < float("inf"))


def tile_x(lon: Column, zoom: int | Column) -> Column:
    n = _side(zoom)
    return F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")


def tile_y(lat: Column, zoom: int | Column) -> Column:
    n = _side(zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return F.greatest(F.least(F.floor((1 - F.asinh(F.tan(phi)) / math.pi) / 2 * n), n - 1), F.lit(0)).cast("long")


def _side(zoom: int | Column) -> Column:
    return F.lit(1 << zoom).cast("long") if isinstance(zoom, int) else F.pow(F.lit(2.0), zoom).cast("long")


def lon_of(x: Column, zoom: int | Column) -> Column:
    return x / _side(zoom) * 360 - 180


def lat_of(y: Column, zoom: int | Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / _side(zoom)))))


def tile_bounds(x: Column, y: Column, zoom: int | Column) -> dict[str, Column]:
    return {"west": lon_of(x, zoom), "south": lat_of(y + 1, zoom), "east": lon_of(x + 1, zoom), "north": lat_of(y, zoom)}


def interleave(x: Column, y: Column, bits: int, z: Column | None = None) -> Column:
    """Bits of x, y (and z) in turn, x lowest. Unrolled, so that it stays in generated code."""
    parts, step = [], 3 if z is not None else 2
    for i in range(bits):
        for k, v in enumerate((x, y) if z is None else (x, y, z)):
            parts.append(F.shiftleft(F.shiftright(v, i).bitwiseAND(1).cast("long"), step * i + k))
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def quadbin(x: Column, y: Column, zoom: int) -> Column:
    free = 52 - 2 * zoom
    head = QUADBIN_HEADER | zoom << 52 | ((1 << free) - 1)
    return F.lit(head).bitwiseOR(F.shiftleft(interleave(x, y, zoom), free)) if zoom else F.lit(head)


def quadbin_parts(cell: Column) -> tuple[Column, Column, Column]:
    """Zoom, x and y of a cell."""
    zoom = F.shiftright(cell, 52).bitwiseAND(31).cast("int")
    bits = cell.bitwiseAND((1 << 52) - 1)

    def gather(first: int) -> Column:
        # Bit i of the coordinate sits 2i + first above the free bits; free = 52 - 2 zoom.
        out = F.lit(0).cast("long")
        for i in range(26):
            top = 50 - 2 * i + first  # place of the i-th highest bit
            out = out + F.when(zoom > i, F.shiftright(bits, top).bitwiseAND(1).cast("long") * F.pow(F.lit(2.0), zoom - 1 - i).cast("long")).otherwise(0)
        return out

    return zoom, gather(0), gather(1)


def hilbert(x: Column, y: Column, zoom: int) -> Column:
    """Place of a tile on the Hilbert curve of its zoom: a fold over bits, so the expression stays small."""
    if not zoom:
        return F.lit(0).cast("long")
    last = (1 << zoom) - 1

    def step(acc: Column, k: Column) -> Column:
        rx, ry = F.call_function("shiftright", acc["x"], k).bitwiseAND(1), F.call_function("shiftright", acc["y"], k).bitwiseAND(1)
        flip = rx == 1
        fx, fy = F.when(flip, last - acc["x"]).otherwise(acc["x"]), F.when(flip, last - acc["y"]).otherwise(acc["y"])
        weight = F.call_function("shiftleft", F.lit(1).cast("long"), k * 2)
        return F.struct(F.when(ry == 0, fy).otherwise(acc["x"]).alias("x"), F.when(ry == 0, fx).otherwise(acc["y"]).alias("y"), (acc["h"] + (rx * 3).bitwiseXOR(ry) * weight).alias("h"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(zoom - 1), F.lit(0)), start, step, lambda acc: acc["h"])


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2.0) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in degrees from 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def metres_per_pixel(lat: Column, zoom: int | Column) -> Column:
    return EARTH_M_PER_PIXEL * F.cos(F.radians(lat)) / _side(zoom)


def lon_lat_of_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres in the Web Mercator plane."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(F.atan(F.sinh(y / r)))
