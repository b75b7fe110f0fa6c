"""Advice from profiles: plain rules over a handful of summary rows, as pure functions."""

from __future__ import annotations

from dataclasses import dataclass

from tilewright.functions.timing import duration_text

NICE = (1, 2, 2.5, 5, 10)


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    message: str
    size: int = 0


def temporal_tiers(duration_ms: int, base_ms: int, most_buckets: int = 675) -> list[int]:
    """Up to two wider widths, each a multiple and at least four times the one before, with two buckets or more."""
    out, before = [], base_ms
    if duration_ms / base_ms <= most_buckets:
        return out
    for factor in (4, 6, 7, 24, 30):
        wide = before * factor
        if len(out) < 2 and duration_ms // wide >= 2:
            out.append(wide)
            before = wide
    return out


def adaptive_target(kind: str, largest: int, median: int) -> int | None:
    """A row target for adaptive windows where times are bursty and tiles uneven."""
    if kind != "Bursty" or not median or largest / median < 10:
        return None
    return min(max(nice(4 * median), 1000), 50_000)


def nice(v: float) -> int:
    """The next round number from below or equal: 1, 2, 2.5, 5 times a power of ten."""
    scale = 10 ** (len(str(int(max(v, 1)))) - 1)
    return int(next((s * scale for s in NICE if s * scale >= v), 10 * scale))


def wants_summary(n: int, mean: float, top_share: float, largest: int) -> bool:
    return n > 1_000_000 and mean > 5000 or n > 100_000 and top_share >= 0.6 and largest > 10_000


def spatial_class(lon_extent: float, lat_extent: float, coverage_z6: float, hotspots: list[int], n: int) -> str:
    if lon_extent < 10 and lat_extent < 10:
        return "Localized"
    if coverage_z6 < 0.005:
        return "Sparse"
    if len(hotspots) >= 3 and sum(sorted(hotspots, reverse=True)[:5]) > n / 2:
        return "Regional"
    return "Global" if coverage_z6 > 0.05 and lon_extent > 100 else "Regional"


def min_zoom(lon_extent: float, lat_extent: float, max_zoom: int) -> int:
    import math

    extent = max(lon_extent, lat_extent)
    return 0 if extent >= 2 else min(max(math.ceil(math.log2(360 / max(extent, 1e-9))), 4), max_zoom)


def recipe(name: str, zooms: tuple[int, int], width_ms: int, tiers: list[int]) -> str:
    """The build call that a profile leads to."""
    more = "".join(f", {duration_text(t)}" for t in tiers)
    return f"{name}: zooms {zooms[0]}-{zooms[1]}, buckets {duration_text(width_ms)}{more}"


def doctor(directory: list[dict], bounds: tuple[float, float, float, float], n: int, has_summary: bool, shares: dict[str, float] | None = None) -> list[Finding]:
    """Findings on an archive from one row a zoom (``zoom, entries, largest``) and each column's share of bytes, worst first."""
    out = []
    low = min((d["zoom"] for d in directory), default=0)
    if low <= 4 and bounds[2] - bounds[0] < 2 and bounds[3] - bounds[1] < 2 and directory:
        out.append(Finding("warning", "z0-bomb", "a small extent is tiled from far out"))
    for d in directory:
        if d["largest"] > 1 << 20:
            out.append(Finding("warning", "oversized-blobs", f"zoom {d['zoom']} has a blob of {d['largest']} bytes", d["largest"]))
        if d["entries"] > 10_000:
            out.append(Finding("info", "large-directory", f"zoom {d['zoom']} has {d['entries']} tiles"))
    if n > 1_000_000 and not has_summary:
        out.append(Finding("warning", "missing-summary-tier", f"{n} features and no summary"))
    for column, share in (shares or {}).items():
        if share >= 0.03:
            out.append(Finding("critical" if share >= 0.5 else "warning", "raw-f64-column", f"{column} takes {share:.0%} of all bytes"))
    rank = {"critical": 0, "warning": 1, "info": 2}
    return sorted(out, key=lambda f: (rank[f.severity], -f.size, f.code, f.message))


def fit_budget(sizes: dict[int, int], budget: int) -> int | None:
    """The deepest zoom whose running sum of bytes stays within a budget."""
    total, best = 0, None
    for z in sorted(sizes):
        total += sizes[z]
        if total > budget:
            break
        best = z
    return best


def greedy_budget(sizes: list[int], scores: list[float], most_rows: int, most_bytes: int) -> list[int]:
    """Rows to keep of one tile: the highest scores up to the count, then by score per byte up to the bytes."""
    order = sorted(range(len(sizes)), key=lambda i: -scores[i])[:most_rows]
    if sum(sizes[i] for i in order) <= most_bytes:
        return sorted(order)
    target, total, kept = int(0.9 * most_bytes), 0, []
    for i in sorted(order, key=lambda i: -scores[i] / max(sizes[i], 1)):
        if total + sizes[i] <= target or total < 0.95 * target and total + sizes[i] <= 1.05 * target:
            kept.append(i)
            total += sizes[i]
    return sorted(kept)
