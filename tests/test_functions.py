"""Unit tests of functions and driver-side operators."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import space, timing, values
from tilewright.operators import advise, cells, geometry, layout, ordered, tiling
from tilewright.sources import features as src


def hilbert_by_hand(z, x, y):
    n = s = 1 << z
    h = 0
    while (s := s // 2) > 0:
        rx, ry = int(x & s > 0), int(y & s > 0)
        h += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
    return h


def test_hilbert_is_a_walk(spark):
    df = spark.range(1 << 8).select((F.col("id") % 16).alias("x"), (F.col("id") / 16).cast("long").alias("y"))
    got = {(r["x"], r["y"]): r["h"] for r in df.withColumn("h", space.hilbert(F.col("x"), F.col("y"), 4)).collect()}
    assert got == {(x, y): hilbert_by_hand(4, x, y) for x in range(16) for y in range(16)}
    walk = sorted(got, key=got.get)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_quadbin_round_trip(spark):
    rows = [(x, y) for x in (0, 1, 77, 255) for y in (0, 3, 128, 255)]
    df = spark.createDataFrame(rows, "x long, y long").withColumn("c", space.quadbin(F.col("x"), F.col("y"), 8))
    zoom, x, y = space.quadbin_parts(F.col("c"))
    for r in df.select("x", "y", zoom.alias("z"), x.alias("x2"), y.alias("y2"), cells.is_cell(F.col("c"), 8).alias("ok"), cells.is_cell(F.col("c"), 9).alias("no")).collect():
        assert (r["x"], r["y"], 8, True, False) == (r["x2"], r["y2"], r["z"], r["ok"], r["no"])


def test_tiles_at_the_edges(spark):
    df = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0)], "lon double, lat double")
    got = df.select(space.tile_x(F.col("lon"), 3).alias("x"), space.tile_y(F.col("lat"), 3).alias("y")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (7, 7), (4, 4)]


def test_durations():
    assert [timing.duration_ms(t) for t in ("500ms", "90s", "30m", "1h", "1d")] == [500, 90_000, 1_800_000, 3_600_000, 86_400_000]
    assert timing.duration_text(5_400_000) == "90m"
    with pytest.raises(ValueError):
        timing.duration_ms("1 month")


def test_negative_times_floor(spark):
    r = spark.createDataFrame([(-1,)], "t long").select(timing.bucket(F.col("t"), 10).alias("b"), timing.to_ms(F.col("t"), "us").alias("m")).first()
    assert (r["b"], r["m"]) == (-10, -1)


def test_outward_rounding(spark):
    df = spark.createDataFrame([(123.4,), (-0.0456,), (0.0,), (20.0,)], "v double")
    got = df.select(values.outward_2sf(F.col("v"), False).alias("a"), values.outward_2sf(F.col("v"), True).alias("b")).collect()
    assert np.allclose([tuple(r) for r in got], [(120, 130), (-0.046, -0.045), (0, 0), (20, 20)])


def test_wkb():
    line = src.encode_wkb("linestring", [[(1, 2), (3, 4)]])
    assert src.decode_wkb(line) == ("linestring", [[(1.0, 2.0, None), (3.0, 4.0, None)]])
    polygon = src.encode_wkb("polygon", [[(0, 0), (1, 0), (1, 1), (0, 0)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.1)]])
    assert len(src.decode_wkb(polygon)[1]) == 2
    ewkb = struct.pack("<BIIddd", 1, 1 | 0x80000000 | 0x20000000, 4326, 5, 6, 7)
    assert src.decode_wkb(ewkb) == ("point", [[(5.0, 6.0, 7.0)]])
    assert src.decode_wkb(struct.pack(">BIdd", 0, 1, 8, 9)) == ("point", [[(8.0, 9.0, None)]])
    for bad in (None, b"", b"\x01", line[:-3]):
        assert src.decode_wkb(bad) is None


def test_read_features_strictness(spark):
    wkb = bytearray(src.encode_wkb("point", [[(10.0, 20.0)]]))
    df = spark.createDataFrame([(wkb, "2024-01-01T00:00:00Z", 1.5), (None, "nonsense", 2.5)], "geometry binary, t string, v double")
    rows = src.read_features(df, "t", strict=False).collect()
    assert [(r["lon"], r["lat"], r["start_ms"], r["v"]) for r in rows] == [(10.0, 20.0, 1_704_067_200_000, 1.5)]
    with pytest.raises(Exception, match="unreadable"):
        src.read_features(df, "t").collect()


def test_geometry_column():
    assert src.geometry_column(["id", "Geom"]) == "Geom"
    assert src.geometry_column(["id", "lat", "lon"]) == ("lon", "lat")
    assert src.geometry_column(["geometry", "g2"], {"primary_column": "g2"}) == "g2"
    with pytest.raises(ValueError):
        src.geometry_column(["id"])
    assert src.is_wgs84({"id": {"authority": "EPSG", "code": 4326}}) and not src.is_wgs84("EPSG:3857")


def test_segment_clip_matches_sampling():
    rng = random.Random(5)
    box = (-1.0, -1.0, 1.0, 1.0)
    for _ in range(300):
        p, q = ((rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(2))
        inside = [t / 2000 for t in range(2001) if all(box[a] <= p[a] + t / 2000 * (q[a] - p[a]) <= box[a + 2] for a in (0, 1))]
        hit = geometry.clip_segment(p, q, box)
        if inside:
            assert abs(hit[0] - inside[0]) < 1e-3 and abs(hit[1] - inside[-1]) < 1e-3


def test_rings():
    square = np.asarray([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert geometry.area(square) == 16
    assert abs(geometry.area(geometry.clip_ring(square, (1, 1, 9, 2)))) == 3
    assert len(geometry.clip_ring(square, (5, 5, 6, 6))) == 0
    wrap = np.asarray([(170, 0), (-170, 0), (-170, 10), (170, 10)], float)
    parts = geometry.split_polygon(wrap)
    assert len(parts) == 2 and sum(abs(geometry.area(p)) for p in parts) == pytest.approx(200)


def test_tracks():
    line = np.asarray([(0.5, 0.5), (80.0, 40.0)])
    tiles = geometry.covered_tiles(line, 4)
    for t in np.linspace(0, 1, 999):
        n = 16
        lon, lat = line[0] + t * (line[1] - line[0])
        y0, y1 = ((1 - math.asinh(math.tan(math.radians(v))) / math.pi) / 2 * n for v in line[:, 1])
        x0, x1 = ((v + 180) / 360 * n for v in line[:, 0])
        assert (int(x0 + t * (x1 - x0)), int(y0 + t * (y1 - y0))) in tiles
    cut = geometry.time_slices(np.asarray([(0, 0, 0), (10, 0, 25)], float), 10)
    assert [(s[0, 2], s[-1, 2]) for s in cut] == [(0, 10), (10, 20), (20, 25)] and cut[1][0, 0] == 4
    assert len(geometry.split_at_antimeridian(np.asarray([(179.0, 0), (-179.0, 2)]))) == 2
    straight = np.asarray([(i, 0, i) for i in range(10)], float)
    assert len(geometry.simplify_timed(straight, 1e-9)) == 2 and len(geometry.simplify_area(straight[:, :2], 1e-9)) == 2


def test_adaptive_windows_are_exact():
    rng = random.Random(11)
    for _ in range(200):
        counts = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        target = rng.randint(1, 15)
        sizes = ordered.split_windows(counts, target)
        assert sum(sizes) == len(counts) and min(sizes) >= 1
        at, sums = 0, []
        for n in sizes:
            sums.append(sum(counts[at : at + n]))
            at += n

        def best(k, items):
            if k == 1:
                return sum(items)
            return min(max(sum(items[:i]), best(k - 1, items[i:])) for i in range(1, len(items) - k + 2))

        if len(counts) <= 8:
            assert max(sums) == best(len(sizes), counts)


def test_throttle_and_stratified(spark):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate((0, 5, 10, 14, 20, 31))], "feature_id long, k long, start_ms long")
    assert [r["start_ms"] for r in ordered.throttle(df, "k", 10).orderBy("start_ms").collect()] == [0, 10, 20, 31]
    tiles = spark.range(60).select(F.lit(1).alias("zoom"), (F.col("id") % 3).alias("bucket_ms"), F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("n"))
    s = ordered.stratified(tiles, 12)
    assert s.count() == 12 and s.select("bucket_ms").distinct().count() == 3


def test_dense_numbers_over_many_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), (F.col("id") * 7919 % 1000).alias("start_ms"))
    got = ordered.dense_numbers(df, "k").orderBy("dense").collect()
    assert [r["dense"] for r in got] == list(range(101))
    assert [(r["first_ms"], r["k"]) for r in got] == sorted((r["first_ms"], r["k"]) for r in got)


def test_layout_and_advice():
    assert layout.pack_cuts([5, 5, 20, 1], 10) == [2, 3, 4]
    assert layout.choose_order(1, 5) == "spatial" and layout.choose_order(5, 5) == "morton3"
    assert advise.temporal_tiers(1000 * 3_600_000, 3_600_000) == [4 * 3_600_000, 24 * 3_600_000]
    assert advise.greedy_budget([10, 10, 10], [1, 3, 2], 2, 100) == [1, 2]
    assert [f.code for f in advise.doctor([{"zoom": 0, "entries": 1, "largest": 2 << 20}], (0, 0, 1, 1), 5, False, {"v": 0.6})] == ["raw-f64-column", "oversized-blobs", "z0-bomb"]
    with pytest.raises(ValueError):
        tiling.check_tiers(1000, [(1500, 3)])
    assert cells.parse_spec("count,v:mean") == [("", "count"), ("v", "mean")]


def test_clusters():
    import pandas as pd

    p = pd.DataFrame({"x": [0, 0.5, 5, 5.2], "y": [0, 0, 0, 0], "weight": [10, 1, 1, 3]})
    c = ordered.clusters(p, 1.0)
    assert c["members"].tolist() == [2, 2] and c["weight"].tolist() == [11, 4]
