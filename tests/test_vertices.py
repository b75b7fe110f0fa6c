"""Vertex codes, grids and mergeable statistics on odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from tilewright.operators import checks, vertices


def test_value_codes_of_odd_values(spark):
    rows = [(1, [0.0, None, 10.0, math.nan, math.inf]), (1, []), (2, [None]), (3, [4.0, 4.0]), (4, None)]
    got = {(r["layer"], tuple(r["v"] or ())[:1]): r for r in vertices.value_codes(spark.createDataFrame(rows, "layer int, v array<double>"), "layer", "v").collect()}
    assert got[1, (0.0,)]["codes"] == [0, 65535, 65534, 65535, 65535] and got[1, ()]["codes"] == []
    assert got[2, (None,)]["codes"] == [65535] and (got[2, (None,)]["offset"], got[2, (None,)]["step"]) == (0.0, 1.0)
    assert got[3, (4.0,)]["codes"] == [0, 0] and got[3, (4.0,)]["offset"] == 4.0 and got[4, ()]["codes"] is None


def test_time_tiers_keep_times_within_a_step(spark):
    rows = [(1, 1000, [1000, 1001, 66535]), (1, 5, []), (2, 0, [0, 10_000_000]), (2, 10**12, [10**12, 10**12 + 5_000_000]), (3, 7, [5, 5 + 10**9]), (4, 0, [0, 10**15]), (5, 0, None)]
    out = vertices.time_tiers(spark.createDataFrame(rows, "layer int, start long, t array<long>"), "layer", "start", "t", 200).collect()
    assert len(out) == len(rows)
    assert {r["layer"]: r["kind"] for r in out} == {1: "u16", 2: "u16_own", 3: "u32", 4: "i64", 5: "i64"}
    most = {"u16": 65535, "u16_own": 65535, "u32": 2**32 - 1, "i64": 2**63}
    for r in out:
        if r["t"]:
            back = [r["origin"] + c * r["step"] for c in r["codes"]]
            assert all(0 <= t - b < r["step"] <= 200 for t, b in zip(r["t"], back)) and max(r["codes"]) <= most[r["kind"]]
        else:
            assert r["codes"] is None


def test_moments_of_parts_merge_to_the_exact_sum_of_squares(spark):
    rows = [("a", i % 3, 1e9 + i) for i in range(50)] + [("a", 9, None), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, part int, v double")
    got = {r["k"]: r for r in vertices.merged_moments(vertices.moments(df, ["k", "part"], "v"), ["k"]).collect()}
    assert got["a"]["n"] == 50 and got["a"]["nulls"] == 1 and math.isclose(got["a"]["m2"], 50 * (50**2 - 1) / 12, rel_tol=1e-8) and got["a"]["low"] == 1e9
    assert (got["b"]["n"], got["b"]["nulls"], got["b"]["mean"]) == (0, 1, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "feature_id long, lon double, lat double, start_ms long")
    assert vertices.voxel_thin(none, {"lon": 1.0}, "feature_id").count() == 0
    assert vertices.sampled_grid(none, spark.createDataFrame([], "i long, j long, node double"), 1.0).count() == 0
    boxes = none.select("start_ms", *[F.col("lon").alias(c) for c in ("west", "east", "south", "north")])
    assert tuple(vertices.replication(boxes, 3, 1000).first()) == (1.0, 1.0)


def test_bucket_verdicts_and_clashes(spark):
    rows = [(5, True), (6, True), (5, False), (None, True), (None, False)]
    df = spark.createDataFrame(rows, "s int, c boolean")
    assert [r[0] for r in df.select(checks.lod_bucket(F.col("s"), F.col("c"), 5)).collect()] == ["ok", "mismatch", "warn", "warn", "ok"]
    with pytest.raises(ValueError):
        vertices.provenance(spark.createDataFrame([(1, 2, 3, 4)], "zoom int, x int, y int, tile_x int"))
