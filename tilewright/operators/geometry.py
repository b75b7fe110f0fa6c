"""Geometry kernels: clipping, simplification, areas, and the placement of lines and polygons on tiles.

Kernels are numpy functions on one geometry. DataFrame forms run them by
``mapInArrow``, so a geometry never leaves its row's task; what has a closed
form (segment clip, ring area) is also given as a Catalyst expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.space import MAX_LAT


def tile_of(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    n = 1 << zoom
    phi = math.radians(min(max(lat, -MAX_LAT), MAX_LAT))
    y = math.floor((1 - math.asinh(math.tan(phi)) / math.pi) / 2 * n)
    return min(math.floor((lon + 180) / 360 * n), n - 1), min(max(y, 0), n - 1)


def box_of(zoom: int, x: int, y: int, buffer_px: float = 0.0) -> tuple[float, float, float, float]:
    """West, south, east, north; the buffer is in pixels of 256 to a tile."""
    n = 1 << zoom
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    b = buffer_px / 256 * 360 / n
    return x / n * 360 - 180 - b, lat(y + 1) - b, (x + 1) / n * 360 - 180 + b, lat(y) + b


def clip_segment(p: tuple[float, float], q: tuple[float, float], box: tuple[float, float, float, float]) -> tuple[float, float] | None:
    """The part of a segment inside a box as two shares of its length, or None (parametric half-plane clipping)."""
    t0, t1 = 0.0, 1.0
    for axis in (0, 1):
        d = q[axis] - p[axis]
        for bound, sign in ((box[axis], -1), (box[axis + 2], 1)):
            room, step = sign * (bound - p[axis]), sign * d
            if step == 0:
                if room < 0:
                    return None
            elif step > 0:
                t1 = min(t1, room / step)
            else:
                t0 = max(t0, room / step)
    return (t0, t1) if t0 <= t1 else None


def clip_shares(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """``clip_segment`` as expressions; outside where the first share exceeds the second."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for p, q, a, b in ((x0, x1, box[0], box[2]), (y0, y1, box[1], box[3])):
        d = q - p
        ta, tb = (F.lit(a) - p) / F.nullif(d, F.lit(0.0)), (F.lit(b) - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= a) & (p <= b)
        low.append(F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(ta, tb)))
        high.append(F.when(d == 0, 1.0).otherwise(F.greatest(ta, tb)))
    return F.greatest(*low), F.least(*high)


def ring_area(lon: Column, lat: Column) -> Column:
    """Signed area of a ring of two arrays (closed or not): positive if counter-clockwise."""
    n = F.size(lon)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(lon, i) * F.get(lat, (i + 1) % n) - F.get(lon, (i + 1) % n) * F.get(lat, i))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def unwrapped(lon: Column) -> Column:
    """Longitudes of a ring within 180 degrees of its first: a ring across the antimeridian becomes one piece. Rings span less than 180 degrees."""
    first = F.get(lon, 0)
    return F.transform(lon, lambda v: F.when(v - first > 180, v - 360).when(v - first < -180, v + 360).otherwise(v))


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring against the four sides of a box in turn; fewer than three points: nothing is left."""
    pts = [tuple(p) for p in ring]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        inside = lambda p: sign * (p[axis] - bound) >= 0  # noqa: B023, E731
        out = []
        for a, b in zip([pts[-1], *pts[:-1]] if pts else [], pts, strict=True):
            if inside(a) != inside(b):
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = bound
                out.append(tuple(cut))
            if inside(b):
                out.append(b)
        pts = out
    return np.asarray(pts, float).reshape(-1, 2)


def split_at_antimeridian(line: np.ndarray) -> list[np.ndarray]:
    """A line as runs without a step of over 180 degrees; a step across is cut at ±180, all further columns (times) in proportion."""
    runs, now = [], [line[0]]
    for p, q in zip(line, line[1:], strict=False):
        if abs(q[0] - p[0]) > 180:
            side = 180.0 if p[0] > 0 else -180.0
            far = q[0] + (360 if side > 0 else -360)
            t = (side - p[0]) / (far - p[0]) if far != p[0] else 0.0
            rest = p[1:] + t * (q[1:] - p[1:])
            now.append(np.asarray([side, *rest]))
            runs.append(np.asarray(now))
            now = [np.asarray([-side, *rest])]
        now.append(q)
    return [*runs, np.asarray(now)]


def split_polygon(ring: np.ndarray) -> list[np.ndarray]:
    """A ring that crosses the date line as its two sides, each within ±180; others as they are."""
    ring = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    step = np.diff(ring[:, 0], prepend=ring[-1, 0])
    if (np.abs(step) <= 180).all():
        return [ring]
    turns = np.cumsum(np.where(step > 180, -360.0, np.where(step < -180, 360.0, 0.0)))
    flat = ring.copy()
    flat[:, 0] += turns - turns[0]
    if np.abs(np.diff(flat[:, 0], append=flat[0, 0])).max() > 180:
        return [ring]  # around a pole: it can't be cut
    out = []
    for k in range(math.floor((flat[:, 0].min() + 180) / 360), math.floor((flat[:, 0].max() + 180) / 360) + 1):
        part = clip_ring(flat, (360.0 * k - 180, -91.0, 360.0 * k + 180, 91.0))
        if len(part) >= 3:
            part[:, 0] -= 360.0 * k
            out.append(part if area(part) * area(flat) >= 0 else part[::-1])
    return out


def covered_tiles(line: np.ndarray, zoom: int) -> set[tuple[int, int]]:
    """All tiles that a line, straight in degrees, touches: its crossings with the grid cut it into steps inside one tile each."""
    n, out = 1 << zoom, set()
    for p, q in zip(line[:, :2].tolist(), line[1:, :2].tolist(), strict=False):
        (x0, y0), (x1, y1) = tile_of(*p, zoom), tile_of(*q, zoom)
        cuts = {0.0, 1.0}
        if q[0] != p[0]:
            cuts.update((k / n * 360 - 180 - p[0]) / (q[0] - p[0]) for k in range(min(x0, x1), max(x0, x1) + 2))
        if q[1] != p[1]:
            cuts.update((math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n)))) - p[1]) / (q[1] - p[1]) for k in range(min(y0, y1), max(y0, y1) + 2))
        ts = sorted(t for t in cuts if 0 <= t <= 1)
        for t in [(a + b) / 2 for a, b in zip(ts, ts[1:], strict=False)] + [0.0, 1.0]:
            out.add(tile_of(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]), zoom))
    return out


def time_slices(verts: np.ndarray, width_ms: int) -> list[np.ndarray]:
    """A track of (lon, lat, ms) cut at every bucket boundary, with a shared point (times cut to whole ms) at each."""
    out, now = [], [verts[0]]
    for p, q in zip(verts, verts[1:], strict=False):
        first = (math.floor(p[2] / width_ms) + 1) * width_ms
        for b in range(int(first), math.ceil(q[2]), width_ms):
            t = (b - p[2]) / (q[2] - p[2])
            cut = np.asarray([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]), b])
            out.append(np.asarray([*now, cut]))
            now = [cut]
        now.append(q)
    return [s for s in [*out, np.asarray(now)] if len(s) > 1]


def clip_track(verts: np.ndarray, zoom: int, buffer_px: float = 8.0) -> list[tuple[int, int, np.ndarray]]:
    """(x, y, vertices) of a track of (lon, lat, ms) in every tile that it touches; a piece for each stay in it."""
    out = []
    for run in split_at_antimeridian(verts):
        for x, y in sorted(covered_tiles(run, zoom)):
            box, pieces, left = box_of(zoom, x, y, buffer_px), [[]], False
            for p, q in zip(run, run[1:], strict=False):
                hit = clip_segment(tuple(p[:2]), tuple(q[:2]), box)
                if hit is None or hit[0] > 0 or left:
                    pieces.append([])
                left = hit is not None and hit[1] < 1
                for t in hit or ():
                    v = p + t * (q - p)
                    v[2] = math.trunc(v[2])
                    if not pieces[-1] or np.abs(v[:2] - pieces[-1][-1][:2]).max() > 1e-9:
                        pieces[-1].append(v)
            out += [(x, y, np.asarray(piece)) for piece in pieces if len(piece) > 1]
    return out


def simplify_area(line: np.ndarray, least: float) -> np.ndarray:
    """Drops, smallest first, inner points whose triangle with their neighbours is under an area (Visvalingam)."""
    keep = list(range(len(line)))

    def tri(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = (line[keep[i + k]][:2] for k in (-1, 0, 1))
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    areas = [math.inf, *(tri(i) for i in range(1, len(keep) - 1)), math.inf]
    while len(keep) > 2:
        i = int(np.argmin(areas))
        if areas[i] >= least:
            break
        del keep[i], areas[i]
        for j in (i - 1, i):
            if 0 < j < len(keep) - 1:
                areas[j] = tri(j)
    return line[keep]


def simplify_timed(verts: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps points of a track that are off the place that constant speed between kept ones gives (time-ratio distance)."""
    keep, todo = np.zeros(len(verts), bool), [(0, len(verts) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, inner = verts[a], verts[b], verts[a + 1 : b]
        share = (inner[:, 2] - p[2]) / (q[2] - p[2]) if q[2] != p[2] else np.zeros(len(inner))
        off = np.hypot(*(inner[:, :2] - (p[:2] + share[:, None] * (q[:2] - p[:2]))).T)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return verts[keep]


def tolerance_deg2(zoom: int) -> float:
    """Area threshold of a zoom: the square of a pixel in degrees."""
    return (156543.0339 / 2**zoom / 111320) ** 2


def tracks(features: DataFrame, key: str) -> DataFrame:
    """``key, start_ms, feature_id, lon, lat``: vertices by track and in order, those of a track together."""
    return features.select(key, "start_ms", "feature_id", "lon", "lat").repartition(key).sortWithinPartitions(key, "start_ms", "feature_id", "lon", "lat")


def _per_track(df: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work`` on the vertices of one track of ``tracks`` at a time: besides it a task holds one batch of rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, [], []

        def packed() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                for r in work(np.concatenate(held)):
                    rows.append((at, *r))
                    if len(rows) >= 50_000:
                        yield packed()
                        rows.clear()
                held.clear()

        for batch in batches:
            keys = batch.column(key)
            verts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat", "start_ms")])
            ids, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (null[1:] != null[:-1])) + 1).tolist(), len(ids)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                now = keys[low].as_py()
                if held and now != at:
                    yield from end()
                at = now
                held.append(verts[low:high])
        yield from end()
        if rows:
            yield packed()

    return df.mapInArrow(run, schema)


def placed_tracks(df: DataFrame, key: str, zoom: int, width_ms: int) -> DataFrame:
    """Pieces by tile and bucket: clipped in space, then cut in time."""

    def work(verts: np.ndarray):
        for x, y, piece in clip_track(verts, zoom):
            for s in time_slices(piece, width_ms):
                yield x, y, int(s[0, 2]) // width_ms * width_ms, len(s), int(s[0, 2]), int(s[-1, 2])

    return _per_track(df, key, work, f"{key} long, x long, y long, bucket_ms long, n_vertices long, start_ms long, end_ms long")


def track_tiles(df: DataFrame, key: str, zoom: int) -> DataFrame:
    return _per_track(df, key, lambda v: sorted(set().union(*(covered_tiles(r, zoom) for r in split_at_antimeridian(v[:, :2])))), f"{key} long, x long, y long")


def simplified(df: DataFrame, key: str, tolerance: float) -> DataFrame:
    return _per_track(df, key, lambda v: [(len(v), len(simplify_timed(v, tolerance)), len(simplify_area(v, tolerance * tolerance)))], f"{key} long, n long, n_timed long, n_area long")


def _clip_rings(x: np.ndarray, y: np.ndarray, n: np.ndarray, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``clip_ring`` of many rings at once: row i holds ``n[i]`` points and meets its own box."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        j = np.arange(x.shape[1])
        before = np.maximum(np.where(j == 0, n[:, None] - 1, j - 1), 0)
        px, py = np.take_along_axis(x, before, 1), np.take_along_axis(y, before, 1)
        bound = bound[:, None]
        v, pv = (x, px) if axis == 0 else (y, py)
        inside, was = sign * (v - bound) >= 0, sign * (pv - bound) >= 0
        real = j < n[:, None]
        cut, keep = real & (inside != was), real & inside
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (bound - pv) / (v - pv)
            cx, cy = px + share * (x - px), py + share * (y - py)
        side = np.broadcast_to(bound, x.shape)
        cx, cy = (side, cy) if axis == 0 else (cx, side)
        out = np.stack([cut, keep], 2).reshape(len(x), -1)
        row, col = np.nonzero(out)
        n = out.sum(1)
        place = (np.cumsum(out, 1) - 1)[row, col]
        nx, ny = np.zeros((len(x), max(1, int(n.max(initial=0))))), np.zeros((len(x), max(1, int(n.max(initial=0)))))
        nx[row, place] = np.stack([cx, x], 2).reshape(len(x), -1)[row, col]
        ny[row, place] = np.stack([cy, y], 2).reshape(len(x), -1)[row, col]
        x, y = nx, ny
    return x, y, n


def _areas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        after = np.where(j + 1 < n, min(j + 1, x.shape[1] - 1), 0)
        rows = np.arange(len(x))
        total += np.where(j < n, x[:, j] * y[rows, after] - x[rows, after] * y[:, j], 0.0)
    return np.abs(total / 2)


def clipped_boxes(df: DataFrame, zoom: int, most: int = 16_384) -> DataFrame:
    """Polygons given as rings of two arrays, clipped against every tile of their box: ``id, x, y, area``.

    Rings of a batch that have as many points are clipped together, ``most`` pairs of ring and tile at a time.
    """
    n = 1 << zoom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list] = {}
            columns = [batch.column(c) for c in ("ring_lon", "ring_lat")]
            flat, starts = [c.flatten().to_numpy(zero_copy_only=False) for c in columns], [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]) for c in columns]
            for i, a, b, a2, b2 in zip(batch.column("id").to_pylist(), starts[0], starts[0][1:], starts[1], starts[1][1:], strict=False):
                lon, lat = flat[0][a:b], flat[1][a2:b2]
                for ring in split_polygon(np.column_stack([lon, lat])):
                    by_size.setdefault(len(ring), []).append((i, ring))
            for rings in by_size.values():
                ids, all_pts = np.array([i for i, _ in rings]), np.stack([r for _, r in rings])
                low, high = all_pts.min(1), all_pts.max(1)
                corners = [np.array([tile_of(*p, zoom) for p in ps.tolist()]) for ps in (low, high)]
                (x0, y1), (x1, y0) = corners[0].T, corners[1].T
                tall = y1 - y0 + 1
                tiles = (x1 - x0 + 1) * tall
                which, first = np.repeat(np.arange(len(ids)), tiles), np.repeat(np.cumsum(tiles) - tiles, tiles)
                nth = np.arange(len(which)) - first
                tx, ty = x0[which] + nth // tall[which], y0[which] + nth % tall[which]
                edge = np.array([math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n)))) for v in range(int(y0.min()), int(y1.max()) + 2)])
                base = int(y0.min())
                for s in range(0, len(which), most):
                    w, u, v = which[s : s + most], tx[s : s + most], ty[s : s + most]
                    pts = all_pts[w]
                    x, y, k = _clip_rings(pts[:, :, 0], pts[:, :, 1], np.full(len(w), pts.shape[1]), (u / n * 360 - 180, edge[v + 1 - base], (u + 1) / n * 360 - 180, edge[v - base]))
                    ok = k >= 3
                    yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (ids[w], u.astype(np.int64), v.astype(np.int64), _areas(x, y, k))], names=["id", "x", "y", "area"])

    return df.mapInArrow(run, "id long, x long, y long, area double")
