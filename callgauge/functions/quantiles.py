"""Exact interpolated quantiles per group, without gathering a group anywhere.

The built-in exact ``percentile`` keeps every distinct value of a group in the
memory of one task. Telemetry is skewed - one model may serve a third of all calls -
so the quantiles are located by counting instead:

1. Count values per (group, bucket). Buckets are fixed steps of a logarithmic
   scale, so this is an ordinary partial aggregation that shrinks to a few thousand
   small rows per group before anything is exchanged.
2. Running totals over those counts tell which bucket holds each wanted rank. The
   wanted buckets are a tiny table; it is counted and broadcast when small.
3. A second scan keeps only values in wanted buckets, counts each distinct value,
   and splits the bucket into 4096 finer steps the same way.
4. The few values that share a finest step are ranked; neighbours are interpolated.

No step sorts or holds more than one finest step of a group. Results equal
``percentile_cont``: position ``p * (n - 1)``, linear between its neighbours.

The counts of step 1 add up. Kept per hour (``bucket_counts``), they give the exact quantiles
of any coarser grain after one scan instead of two (``quantiles_of_counts``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.joins import group_join
from callgauge.session import BROADCAST_ROWS, broadcast_if_small

# steps per factor e of the value; a bucket is about 0.4 % wide
STEPS = 256
FINER_STEPS = 4096

STANDARD_PROBABILITIES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


# log1p is monotonic, so a larger value never lands in an earlier bucket; NaN is the
# largest value, as in SQL ordering
SCALE = f"nanvl(signum(value) * log1p(abs(value)) * {STEPS}D, DOUBLE('Infinity'))"


def _holds_rank(first: str, probabilities: Sequence[float]) -> str:
    """Whether the ``n`` values from 0-based rank ``first`` on include one that is
    needed: a neighbour of the position ``p * (total - 1)`` of some quantile."""
    tests = []
    for p in probabilities:
        for rank in (f"floor({p}D * (total - 1))", f"ceil({p}D * (total - 1))"):
            tests.append(f"({rank} >= {first} AND {rank} < {first} + n)")
    return " OR ".join(tests)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    probabilities: Mapping[str, float] = STANDARD_PROBABILITIES,
    broadcast_rows: int = BROADCAST_ROWS,
    null_keys: bool = True,
) -> DataFrame:
    """One row per group: ``n_<measure>`` and ``<p>_<measure>`` columns.

    ``measures`` maps output names to numeric columns. NULL values are skipped; a
    group that has none but NULLs gets NULL quantiles and a count of 0, provided
    another measure has values. ``df`` is scanned twice. ``null_keys=False`` promises
    that no key is NULL, which saves exchanges.
    """
    values = _values(df, keys, measures)
    counts = values.groupBy(*keys, "measure", "bucket").agg(F.expr("count(*) AS n"))
    return _located(values, counts, keys, measures, probabilities, broadcast_rows, null_keys)


def bucket_counts(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """(keys, measure, bucket, n): a sparse histogram per group, one row per bucket in use.

    Histograms of parts of a table, or of finer groups, are merged by adding up ``n``.
    """
    values = _values(df, keys, measures)
    return values.groupBy(*keys, "measure", "bucket").agg(F.expr("count(*) AS n"))


def quantiles_of_counts(
    counts: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    probabilities: Mapping[str, float] = STANDARD_PROBABILITIES,
    broadcast_rows: int = BROADCAST_ROWS,
    null_keys: bool = True,
) -> DataFrame:
    """As ``exact_quantiles``, from the histograms of exactly the rows of ``df``.

    ``counts`` may hold several rows per group and bucket. ``df`` is scanned once.
    """
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    values = _values(df, keys, measures)
    return _located(values, merged, keys, measures, probabilities, broadcast_rows, null_keys)


def _values(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """One row per value that is not NULL, with its bucket."""
    columns = ", ".join(
        f"named_struct('measure', '{m}', 'value', CAST(`{c}` AS DOUBLE))"
        for m, c in measures.items()
    )
    return (
        df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({columns}))")
        .where("value IS NOT NULL")
        .selectExpr("*", f"floor({SCALE}) AS bucket")
    )


def _located(
    values: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    probabilities: Mapping[str, float],
    broadcast_rows: int,
    null_keys: bool,
) -> DataFrame:
    """The quantiles of ``values``, whose buckets have the sizes ``counts`` tells."""
    wanted = list(probabilities.values())
    series = [*keys, "measure"]

    # 1 + 2: counts per bucket, and the buckets that hold a wanted rank
    over_series = f"PARTITION BY {', '.join(f'`{c}`' for c in series)}"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    buckets = (
        counts.selectExpr(
            "*",
            f"coalesce(sum(n) OVER ({over_series} ORDER BY bucket {before}), 0) AS below",
            f"sum(n) OVER ({over_series}) AS total",
        )
        .where(_holds_rank("below", wanted))
        .drop("n")
    )
    buckets = broadcast_if_small(buckets, broadcast_rows)

    # 3: distinct values of those buckets, split into finer steps
    place = [*series, "bucket", "below", "total"]
    found = (
        group_join(values, buckets, [*series, "bucket"], null_keys=null_keys)
        .selectExpr("*", f"floor({SCALE} * {FINER_STEPS}D) AS step")
        .groupBy(*place, "step", "value")
        .agg(F.expr("count(*) AS n"))
    )
    steps = (
        found.groupBy(*place, "step")
        .agg(F.expr("sum(n) AS n"))
        .selectExpr(
            "*",
            f"below + coalesce(sum(n) OVER ({over_series}, bucket ORDER BY step {before}), 0)"
            " AS step_below",
        )
        .where(_holds_rank("step_below", wanted))
        .select(*series, "step", "step_below")
    )

    # 4: rank the values of the finest step
    ranked = group_join(found, steps, [*series, "step"], null_keys=null_keys).selectExpr(
        "*",
        f"step_below + coalesce(sum(n) OVER ({over_series}, step ORDER BY value {before}), 0)"
        " AS first",
    )
    return ranked.groupBy(*keys).agg(*map(F.expr, _outputs(measures, probabilities)))


def _outputs(measures: Mapping[str, str], probabilities: Mapping[str, float]) -> list[str]:
    columns = []
    for m in measures:
        mine = f"measure = '{m}'"
        columns.append(f"coalesce(max(total) FILTER (WHERE {mine}), 0) AS `n_{m}`")
        for name, p in probabilities.items():
            position = f"({p}D * (total - 1))"
            low, high = (
                f"max(value) FILTER (WHERE {mine} AND {rank} >= first AND {rank} < first + n)"
                for rank in (f"floor{position}", f"ceil{position}")
            )
            share = f"max({position} - floor{position}) FILTER (WHERE {mine})"
            columns.append(f"{low} + {share} * ({high} - {low}) AS `{name}_{m}`")
    return columns


def approximate_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    probabilities: Mapping[str, float] = STANDARD_PROBABILITIES,
    accuracy: int = 10_000,
) -> DataFrame:
    """Same columns from one scan, with a rank error of at most ``n / accuracy``."""
    columns = []
    for m, c in measures.items():
        columns.append(F.count(c).alias(f"n_{m}"))
        columns += [
            F.percentile_approx(F.col(c), F.lit(float(p)), F.lit(accuracy)).alias(f"{name}_{m}")
            for name, p in probabilities.items()
        ]
    return df.groupBy(*keys).agg(*columns)
