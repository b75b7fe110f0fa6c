"""Steps whose cost must not grow faster than their input, against brute force on small blocks and odd rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Row

from tilewright.operators import geometry, joins, ordered, payload, profile


def test_overlaps_over_several_blocks(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 300), t := rng.randint(0, 40), t + rng.choice([0, 1, 9, 10**14])) for k, n in ((1, 60), (2, 7), (3, 1), (None, 3)) for _ in range(n)]
    rows += [(4, i, 5, 5) for i in range(30)]
    df = spark.createDataFrame([*rows, (1, 999, None, 5)], "k long, id long, start_ms long, end_ms long")
    want = sorted((k, i, j, max(s, u), min(e, v)) for k, i, s, e in rows for m, j, u, v in rows if k is not None and k == m and i < j and s <= v and u <= e)
    for block in (4, 4096):
        assert sorted(map(tuple, joins.overlapping(df, "k", block).collect())) == want


def test_nearest_in_a_crowd_and_alone(spark):
    rng = random.Random(6)
    spot = lambda: (rng.choice([0.5, 0.51, 3.0, -0.0, rng.uniform(-2, 2)]), rng.choice([0.5, 0.25, rng.uniform(-2, 2)]))
    a, b = [(i, *spot()) for i in range(120)], [(i, *spot()) for i in range(120)]
    left, right = spark.createDataFrame([*a, (-1, None, 0.5)], "a long, x double, y double"), spark.createDataFrame([*b, (-1, 0.5, None)], "b long, x double, y double")
    want = {}
    for i, x, y in a:
        d2, j = min(((x - u) * (x - u) + (y - v) * (y - v), j) for j, u, v in b)
        if d2 <= 0.81:
            want[i] = (j, d2)
    assert {r["a"]: (r["b"], r["d2"]) for r in joins.nearest_on_grid(left, right, 1.0, 0.9).collect()} == want
    assert {r["a"]: r["d2"] for r in joins.nearest_on_grid(left, right, 1.0, 0.9, ids=False).collect()} == {i: d for i, (_, d) in want.items()}


def test_nearest_sorts_no_candidates(spark):
    p = spark.range(10).selectExpr("id AS a", "id * 1.0D AS x", "id * 1.0D AS y")
    plan = joins.nearest_on_grid(p, p.withColumnRenamed("a", "b"), 1.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_ranges_agree_when_branches_merge_partitions(spark):
    df = spark.range(5000).selectExpr("id * 37 % 5000 AS k", "id % 7 AS n", "concat(sha2(id || 'a', 512), sha2(id || 'b', 512)) AS wide").repartition(16)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for c, v in zip(before, ("32", "24k", "false")):
        spark.conf.set(c, v)
    try:
        assert "PARTITION_ID" not in ordered.stride(df, 300, ["k"])._jdf.queryExecution().toString().upper()  # ids differ by branch
        assert sorted(r["k"] for r in ordered.stride(df, 300, ["k"]).collect()) == list(range(0, 5000, 17))
        at = 0
        for r in sorted(payload.running(df, ["k"], "n").collect(), key=lambda r: r["k"]):
            assert (r["start"], r["end"]) == (at, at + r["n"])
            at = r["end"]
        assert {r["v"]: r["upto"] for r in profile.running_counts(df.selectExpr("CASE WHEN k > 0 THEN k END AS v", "1L AS n")).collect()} == {k or None: k + 1 for k in range(5000)}
        t = df.selectExpr("k AS user_id", "k DIV 3 AS start_ms", "wide")
        assert {r["user_id"]: r["dense"] for r in ordered.dense_numbers(t, "user_id").collect()} == {k: k for k in range(5000)}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_windows_of_many_atoms_in_time():
    rng, begun = random.Random(8), time.process_time()
    counts = [rng.randint(1, 3) for _ in range(300_000)]
    sizes = ordered.split_windows(counts, 50)
    assert sum(sizes) == len(counts) and min(sizes) > 0
    assert time.process_time() - begun < 10  # was 3 s for 100 000 atoms, and grew with the square


def test_rings_clipped_together_as_one_by_one(spark):
    rng = random.Random(9)
    rings = [[(rng.uniform(-179, 179), rng.uniform(-80, 80)) for _ in range(rng.randint(3, 6))] for _ in range(40)]
    rings += [[(170.0, 0.0), (-170.0, 0.0), (-170.0, 9.0), (170.0, 9.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(i, [p[0] for p in r], [p[1] for p in r]) for i, r in enumerate(rings)], "id long, ring_lon array<double>, ring_lat array<double>")
    want = {}
    for i, r in enumerate(rings):
        for ring in geometry.split_polygon(np.array(r)):
            (x0, y1), (x1, y0) = geometry.tile_of(*ring.min(0), 3), geometry.tile_of(*ring.max(0), 3)
            for x, y in [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]:
                part = geometry.clip_ring(ring, geometry.box_of(3, x, y))
                if len(part) >= 3:
                    want[i, x, y] = abs(geometry.area(part))
    got = {(r["id"], r["x"], r["y"]): r["area"] for r in geometry.clipped_boxes(df, 3, 100).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_tracks_come_in_rows_not_whole(spark):
    rows = [(u, 7 * i % 50, i, float(u or 0) + i % 9, i % 5 * 1.0) for u in (1, 2, None, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id long, start_ms long, feature_id long, lon double, lat double")
    tracks = geometry.tracks(df, "user_id")
    assert tracks.columns == ["user_id", "start_ms", "feature_id", "lon", "lat"]  # no column of all vertices
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, tiles = sorted(map(str, geometry.simplified(tracks, "user_id", 2.0).collect())), sorted(map(str, geometry.track_tiles(tracks, "user_id", 6).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, want_tiles = [], []
    for u in (1, 2, None, 3):
        v = np.array([(r[3], r[4], r[1]) for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2]))], float)
        want.append(str(Row(user_id=u, n=50, n_timed=len(geometry.simplify_timed(v, 2.0)), n_area=len(geometry.simplify_area(v, 4.0)))))
        want_tiles += [str(Row(user_id=u, x=x, y=y)) for x, y in geometry.covered_tiles(v, 6)]
    assert got == sorted(want) and tiles == sorted(want_tiles)
