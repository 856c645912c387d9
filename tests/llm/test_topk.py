from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, scale=64):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in v]
        vectors[i] = max(vectors.get(i, q), q)
    out = []
    for i, q in vectors.items():
        if i % 20:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, w, strict=True)), j)
            for j, w in vectors.items()
            if j != i and len(w) == len(q)
        )
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.search(df, F.col("vec_id") % 20 == 0, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(("block", "run", "group"), [(512, 16, 1024), (7, 3, 2), (1, 1, 1)])
def test_matches_brute_force(spark, block, run, group):
    rows = vectors(60, 8)
    assert found(spark, rows, k=5, block=block, run=run, group=group) == brute(rows, 5)


def test_ties_and_hot_vectors(spark):
    rows = vectors(200, 4) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    assert found(spark, rows, k=20, block=16, run=4) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [
        *vectors(30, 3),
        (40, None),
        (41, [1.0, None, 2.0]),
        (42, [1.0, float("nan"), 2.0]),
        (43, [float("inf"), 0.0, 0.0]),
        (None, [1.0, 1.0, 1.0]),
        (60, [0.5, 0.5]),
        (61, [0.25, -0.5]),
        (80, []),
        (81, []),
        (20, [9.0, 9.0, 9.0]),  # an id twice
        (-20, [-1.0, -2.0, -3.0]),
    ]
    assert found(spark, rows, k=4) == brute(rows, 4)
    assert found(spark, rows[:0], k=4) == []
    assert found(spark, [(1, [1.0])], k=4) == []


@pytest.mark.parametrize(("size", "peak"), [(2.0**7, 1.0), (2.0**20, 1.0), (2.0**7, 2.0**34)])
def test_widths(spark, size, peak):
    """Components of two, four and eight bytes, several lengths side by side."""
    rows = [(i, [x * size for x in v]) for i, v in vectors(50, 4)]
    rows += [(100 + i, v[: 1 + i % 3]) for i, v in vectors(60, 4, 5)] + [(201, [peak, 0.0, 0.0, 0.0])]
    assert found(spark, rows, k=3, block=4, run=2, group=3) == brute(rows, 3)


def test_narrowest_width():
    limits = {2: (-(2**15), 2**15 - 1), 4: (-(2**15) - 1, 2**15), 8: (-(2**31) - 1, 2**31)}
    for width, values in limits.items():
        assert all(topk._width(np.array([0, v])) == width for v in values)


def test_blocks_move_once(spark, monkeypatch):
    """Of a plan with many groups and runs, only the query packs are copied."""
    monkeypatch.setattr(topk, "TASKS", 3)
    rows = vectors(400, 4)
    assert found(spark, rows, k=3, block=8, run=1, group=2) == brute(rows, 3)
    df = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=3, block=8)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "CoGroup" not in plan


def test_fewer_than_k(spark):
    rows = vectors(5, 2)
    assert found(spark, rows) == brute(rows, 20)


def test_clashing_columns(spark):
    df = spark.createDataFrame(vectors(25, 2), SCHEMA)
    for c in ("id", "vec", "dim", "part", "score", "asks"):
        df = df.withColumn(c, F.lit("x"))
    assert topk.search(df, F.col("vec_id") % 20 == 0, k=2).count() == 4


def test_bounds_skip_blocks():
    rng = np.random.default_rng(2)
    blocks = []
    for b in range(20):
        v = rng.integers(0, 10, size=(50, 6)) + (100 if b == 13 else 0)
        ids = np.arange(b * 50, b * 50 + 50)
        blocks.append((ids, v, v.max(axis=0), v.min(axis=0)))
    queries = rng.integers(1, 5, size=(8, 6))
    *_, scored = topk.search_run(blocks, np.full(8, -1), queries, 10)
    assert scored == 8  # one block per query


def test_large_values_stay_exact():
    a = np.array([[2**40, 1]])
    b = np.array([[2**20, 3]])
    assert topk._product(a, b)[0, 0] == 2**60 + 3
