"""Exact quantiles against numpy, with the shapes that make them hard."""

from __future__ import annotations

import numpy as np
import pytest

from callgauge.functions.quantiles import (
    approximate_quantiles,
    bucket_counts,
    exact_quantiles,
    quantiles_of_counts,
)
from callgauge.plans import reports, rollup, tables

GROUPS = {
    "one": [5.0],
    "two": [1.0, 2.0],
    "equal": [7.25] * 5000,
    "hot": [1000.0 + i * 1e-7 for i in range(3000)],  # all in one bucket
    "spread": [float(10**e) for e in range(-6, 12)] * 7,
    "zero": [0.0, 0.0, 0.0, 1e-9, 3.0],
    "signed": [-1000.0, -10.5, -0.1, 0.0, 0.1, 10.5, 1000.0, 1001.0],
    "random": list(np.random.default_rng(5).lognormal(5, 2, 4000)),
    None: [1.0, 2.0, 4.0, 8.0],  # a NULL key is a group like any other
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, float(v), None if g == "two" else float(v) * 2) for g, vs in GROUPS.items() for v in vs]
    return spark.createDataFrame(rows, "g string, a double, b double")


# 0 rows forces the shuffled join that a large number of groups would use
@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_exact_quantiles_equal_numpy(values, broadcast_rows):
    report = exact_quantiles(values, ["g"], {"a": "a", "b": "b"}, broadcast_rows=broadcast_rows)
    got = {r.g: r for r in report.collect()}
    assert set(got) == set(GROUPS)
    for g, vs in GROUPS.items():
        assert got[g].n_a == len(vs)
        for p in (50, 95, 99):
            assert got[g][f"p{p}_a"] == pytest.approx(np.percentile(vs, p), rel=1e-12, abs=1e-12)
            if g == "two":
                assert got[g][f"p{p}_b"] is None
            else:
                expected = np.percentile([v * 2 for v in vs], p)
                assert got[g][f"p{p}_b"] == pytest.approx(expected, rel=1e-12, abs=1e-12)
    assert got["two"].n_b == 0


def test_approximate_quantiles_stay_within_their_rank_error(values):
    got = {r.g: r for r in approximate_quantiles(values, ["g"], {"a": "a"}).collect()}
    ordered = sorted(GROUPS["random"])
    rank = np.searchsorted(ordered, got["random"].p95_a)
    assert abs(rank - 0.95 * len(ordered)) <= 2


def test_rollup_latency_estimates(spark, sf_dir):
    """Merged sketches give the exact counts and percentiles close to the exact ones."""
    calls = tables.calls(spark, sf_dir)
    hourly = rollup.sums_by_hour(calls)
    exact = {r.model: r for r in reports.latency(calls, tables.AS_OF, 720).collect()}
    for r in rollup.latency(hourly, tables.AS_OF, 720).collect():
        assert r.n > 0
        if r.model in exact and exact[r.model].provider == r.provider:
            assert r.n == exact[r.model].n
            # a small sketch keeps every value, so it returns one of the neighbours
            assert r.p50_latency == pytest.approx(exact[r.model].p50_latency, rel=0.25)
    approx = {r.model: r.n for r in reports.latency(calls, tables.AS_OF, 720, approx=True).collect()}
    assert approx == {m: r.n for m, r in exact.items()}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_merged_histograms_give_the_same_quantiles(spark, broadcast_rows):
    """Counts of finer groups and of parts of the rows, added up."""
    rows = [(f"g{i % 3}", i % 7, None if i % 11 == 0 else float(i * i % 997)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, part int, x double")
    fine = [
        bucket_counts(df.where(f"part % 2 = {p}"), ["g", "part"], {"x": "x"}).drop("part")
        for p in (0, 1)
    ]
    got = quantiles_of_counts(
        fine[0].unionByName(fine[1]), df, ["g"], {"x": "x"}, broadcast_rows=broadcast_rows
    )
    want = exact_quantiles(df, ["g"], {"x": "x"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
