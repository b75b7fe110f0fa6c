"""Queries that work on whole tables, against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tilewright.plans import catalogue

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def ms(t):
    return (t - type(t)(1970, 1, 1)).days * 86_400_000


def test_interval_overlap_all(spark):
    ordered = {o["o_orderkey"]: ms(o["o_orderdate"]) for o in table("orders")}
    by_key = {}
    for r in table("lineitem"):
        if r["l_orderkey"] in ordered:
            a, b = sorted((ordered[r["l_orderkey"]], ms(r["l_shipdate"])))
            by_key.setdefault(r["l_suppkey"] % 50, []).append((r["l_orderkey"] * 10 + r["l_linenumber"], a, b))
    want = sorted((k, i, j, max(a, c), min(b, e)) for k, rows in by_key.items() for i, a, b in rows for j, c, e in rows if i < j and a <= e and c <= b)
    got = sorted(map(tuple, catalogue.queries()["interval_overlap_all"](spark, SF).select("k", "a", "b", "start_ms", "end_ms").collect()))
    assert got == want
    assert any(i // 10 % 40 for _, i, _, _, _ in got)


def test_interval_overlap_has_every_order(spark):
    rows = catalogue.queries()["interval_overlap"](spark, SF).select("a", "b").collect()
    assert len({r["a"] // 10 % 40 for r in rows} | {r["b"] // 10 % 40 for r in rows}) == 40


def test_grid_nearest_match(spark):
    pts = [(r["event_id"], -180 + r["user_id"] * 7919 % 24 * 15.0 + r["event_id"] * 31 % 500 / 100, -60 + r["user_id"] * 104729 % 9 * 13.0 + r["event_id"] * 17 % 400 / 100) for r in table("events")]
    right = np.array([p[1:] for p in pts if p[0] % 2 == 0])
    want = {}
    for i, x, y in pts:
        if i % 2:
            d2 = ((right - (x, y)) ** 2).sum(1).min()
            if d2 <= 1:
                want[i] = round(d2, 9)
    got = {r["a"]: r["d2"] for r in catalogue.queries()["grid_nearest_match"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-9)


def test_ring_area(spark):
    want = {r["event_id"]: (r["event_id"] % 17 * 0.5 + 0.5) * (r["event_id"] % 11 * 0.5 + 0.5) for r in table("events")}
    rows = catalogue.queries()["ring_area"](spark, SF).collect()
    assert len(rows) == len(want) and {r["id"]: r["area"] for r in rows} == pytest.approx(want, abs=1e-4)
