"""The hourly rollup: (hour, provider, model, status) with sums and percentiles.

Sums can be added up to any coarser grain. Percentiles cannot, so the rollup also
carries mergeable sketches of latency and time to first token. Exact percentiles of coarser
grains come from stored histograms (``histograms``, ``exact_percentiles``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions.instants import truncate, utc_literal
from callgauge.functions.joins import group_join
from callgauge.functions.quantiles import (
    STANDARD_PROBABILITIES,
    bucket_counts,
    exact_quantiles,
    quantiles_of_counts,
)
from callgauge.plans.reports import MAX_DAYS, MAX_HOURS, MODEL_KEYS, SUCCESS
from callgauge.session import materialize
from callgauge.sources.calls import MONTH, bounded, since

KEYS = ("hour", "provider", "model", "status")
SUMS = ("n", "input_tokens", "output_tokens", "total_latency_ms", "total_cost")
SKETCHES = ("latency_sketch", "ttft_sketch")
MEASURES = {"latency_ms": "latency_ms", "ttft_ms": "ttft_ms"}
WINDOW_DAYS = 30
# estimated percentiles are off by about 1.7 / SKETCH_SIZE of the ranks
SKETCH_SIZE = 1600


def totals() -> list[Column]:
    """The additive columns of the rollup."""
    return [
        F.count("*").alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("total_cost").alias("total_cost"),
    ]


def sketches() -> list[Column]:
    """Mergeable quantile sketches; their size does not grow with the group."""
    return [
        F.kll_sketch_agg_double("latency_ms", SKETCH_SIZE).alias("latency_sketch"),
        F.kll_sketch_agg_double("ttft_ms", SKETCH_SIZE).alias("ttft_sketch"),
    ]


def _with_hour(calls: DataFrame) -> DataFrame:
    return calls.withColumn("hour", truncate("hour", F.col("created_at")))


def sums_by_hour(calls: DataFrame, with_sketches: bool = True) -> DataFrame:
    """Everything of the rollup but the exact percentiles, from one scan."""
    columns = [*totals(), *(sketches() if with_sketches else [])]
    return _with_hour(calls).groupBy(*KEYS).agg(*columns)


def by_hour(calls: DataFrame, with_sketches: bool = True) -> DataFrame:
    """Rollup rows of all given calls."""
    sums = sums_by_hour(calls, with_sketches)
    quantiles = exact_quantiles(_with_hour(calls), KEYS, MEASURES, null_keys=False)
    quantiles = quantiles.drop("n_latency_ms", "n_ttft_ms")
    quantile_columns = [c for c in quantiles.columns if c not in KEYS]
    joined = group_join(sums, quantiles, KEYS, "left", null_keys=False)
    sketched = SKETCHES if with_sketches else ()
    return joined.select(*KEYS, *SUMS, *quantile_columns, *sketched)


def hourly(
    calls: DataFrame, as_of: datetime | str, days: int = WINDOW_DAYS, with_sketches: bool = True
) -> DataFrame:
    """Rollup of the last ``days`` before ``as_of``."""
    return by_hour(since(calls, as_of, 24 * days), with_sketches)


def histograms(calls: DataFrame) -> DataFrame:
    """Sparse histograms of latency and time to first token per rollup row, to be stored.

    At most some thousand rows per hour and group however many calls it has; those of
    several loads are simply kept side by side.
    """
    return bucket_counts(_with_hour(calls), KEYS, MEASURES)


def exact_percentiles(
    counts: DataFrame, calls: DataFrame, grain: str = "day", keys: Sequence[str] = KEYS[1:]
) -> DataFrame:
    """Exact percentiles at a coarser grain, from stored histograms and one scan.

    ``counts`` are the histograms of exactly these calls; only values in the buckets that
    hold a wanted rank are compared.
    """
    coarse = counts.withColumn(grain, truncate(grain, F.col("hour"))).drop("hour")
    dated = calls.withColumn(grain, truncate(grain, F.col("created_at")))
    return quantiles_of_counts(coarse, dated, (grain, *keys), MEASURES, null_keys=False)


def reaggregate(rollup: DataFrame, grain: str = "day") -> DataFrame:
    """The rollup at a coarser grain.

    Sums are exact. Percentiles come from the merged sketches where the rollup has
    them; hourly percentiles are never averaged.
    """
    columns = [F.sum(c).alias(c) for c in SUMS]
    if all(c in rollup.columns for c in SKETCHES):
        columns += [F.kll_merge_agg_double(c).alias(c) for c in SKETCHES]
    coarse = rollup.groupBy(truncate(grain, F.col("hour")).alias(grain), *KEYS[1:]).agg(*columns)
    estimates = {
        f"{name}_{measure}_ms": _sketched(f"{measure}_sketch", p)
        for measure in ("latency", "ttft")
        for name, p in STANDARD_PROBABILITIES.items()
    }
    return coarse.withColumns(estimates) if SKETCHES[0] in coarse.columns else coarse


def _sketched(sketch: str, p: float) -> Column:
    """A percentile from a sketch; NULL when the sketch saw no value."""
    return F.when(
        F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p))
    )


def save(
    rollup: DataFrame, path: str, as_of: datetime | str, first: Column | None = None
) -> None:
    """Store rollup rows by day, replacing the days they cover.

    With ``first``, every day from then to ``as_of`` is replaced: one without rows gets a
    row that counts nothing, which ``read`` leaves out.
    """
    rows = rollup.withColumn("refreshed_at", utc_literal(as_of)).withColumn(
        "day", F.col("hour").cast("date")
    )
    if first is not None:
        rows = materialize(rows)  # its days are asked for, then it is written
        span = F.sequence(first.cast("date"), utc_literal(as_of).cast("date"))
        days = rollup.sparkSession.range(1).select(F.explode(span).alias("day"))
        empty = days.join(rows.select("day").distinct(), "day", "left_anti")
        rows = rows.unionByName(
            empty.withColumn("n", F.lit(0).cast("bigint")), allowMissingColumns=True
        )
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def refresh(
    calls: DataFrame, path: str, as_of: datetime | str, days: int = WINDOW_DAYS
) -> None:
    """Recompute the last ``days`` whole days; a full recompute absorbs late calls.

    Every day of the span is recomputed from its first hour and replaced, also one whose
    calls are gone.
    """
    start = truncate("day", utc_literal(as_of) - F.make_dt_interval(days=F.lit(days)))
    recent = calls.where(F.col("created_at") >= start)
    if MONTH in calls.columns:
        recent = recent.where(F.col(MONTH) >= F.trunc(start.cast("date"), "month"))
    save(by_hour(recent), path, as_of, start)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup, without the marks of days that have no calls."""
    return spark.read.parquet(path).where(F.col("n") > 0)


# --- the reports, answered from the rollup ---------------------------------------------
#
# They read a few rows per hour instead of every call. The time bound works on whole
# hours: an hour counts when it starts at or after the bound, so with ``as_of`` on the
# hour the answers equal those from the calls.


def _since(rollup: DataFrame, as_of: datetime | str, hours: int) -> DataFrame:
    start = utc_literal(as_of) - F.make_dt_interval(hours=F.lit(hours))
    recent = rollup.where(F.col("hour") >= start)
    return recent.where(F.col("day") >= start.cast("date")) if "day" in rollup.columns else recent


def latency(rollup: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Latency report from merged sketches: counts are exact, percentiles estimates."""
    recent = _since(rollup, as_of, bounded(hours, 1, MAX_HOURS, "hours"))
    merged = (
        recent.where(F.col("status") == SUCCESS)
        .groupBy(*MODEL_KEYS)
        .agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c).alias(c) for c in SKETCHES])
    )
    report = merged.withColumns(
        {
            f"{name}_{measure}": _sketched(f"{measure}_sketch", p)
            for measure in ("latency", "ttft")
            for name, p in STANDARD_PROBABILITIES.items()
        }
    )
    return report.drop(*SKETCHES).orderBy(F.col("n").desc(), *MODEL_KEYS)


def throughput(rollup: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    recent = _since(rollup, as_of, bounded(hours, 1, MAX_HOURS, "hours"))
    tokens, seconds = F.sum("output_tokens"), F.sum("total_latency_ms") / F.lit(1000.0)
    report = (
        recent.where(F.col("status") == SUCCESS)
        .groupBy(*MODEL_KEYS)
        .agg(
            F.sum("n").alias("n"),
            tokens.alias("total_output_tokens"),
            seconds.alias("total_latency_s"),
            F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0)).alias("tokens_per_second"),
        )
    )
    return report.orderBy(F.col("tokens_per_second").desc(), *MODEL_KEYS)


def status_by_hour(rollup: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    recent = _since(rollup, as_of, bounded(hours, 1, MAX_HOURS, "hours"))
    return recent.groupBy("hour", "status").agg(F.sum("n").alias("n")).orderBy("hour", "status")


def cost_by_day(rollup: DataFrame, as_of: datetime | str, days: int = 14) -> DataFrame:
    recent = _since(rollup, as_of, 24 * bounded(days, 1, MAX_DAYS, "days"))
    report = recent.groupBy(F.col("hour").cast("date").alias("day"), *MODEL_KEYS).agg(
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("cost_usd"), F.sum("n").alias("n")
    )
    return report.orderBy("day", F.col("cost_usd").desc(), *MODEL_KEYS)
