"""Near-dedup against all pairs on small fixtures."""

import random
import re

import numpy as np
import pytest

from tilewright.llm import near_dedup

SCHEMA = "doc_id long, text string, n long, component_id string"


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def fixture(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, ids = [], iter(rng.sample(range(10_000), 400))
    for _ in range(6):
        base = rng.choices(words, k=rng.randint(40, 160))
        for _ in range(rng.randint(5, 25)):  # substitutions
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((next(ids), " ".join(t)))
        for k in range(8):  # a chain of ever shorter texts
            rows.append((next(ids), " ".join(base[: len(base) - 6 * k])))
    rows += [(next(ids), None), (next(ids), ""), (next(ids), " \n "), (next(ids), "One two"), (next(ids), "one TWO"), (next(ids), "x")]
    return rows


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_components(spark, seed, size, percent):
    rows = fixture(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, shingle=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_components_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rows = fixture(4)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (None, "other words here", 1, "x"), (5, "a b c d e f", 1, "x")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5, False), (None, None, True), (5, 5, True)], key=str)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 1000):
        assert (near_dedup.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != near_dedup._EMPTY).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150).astype(np.uint64)])
    same = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(same - 850 / 1150) < 0.15
