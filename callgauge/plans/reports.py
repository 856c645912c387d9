"""Dashboard reports.

Each report scans only the columns it names and the months its time bound reaches.
Groups are folded in the map tasks before the exchange, and every order has
tie-breakers, so repeated runs list rows alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.instants import truncate
from callgauge.functions.quantiles import approximate_quantiles, exact_quantiles
from callgauge.sources.calls import bounded, since

SUCCESS = "SUCCESS"
MAX_HOURS = 720
MAX_DAYS = 90
MAX_SESSIONS = 500
MODEL_KEYS = ("provider", "model")


def _succeeded(calls: DataFrame, as_of: datetime | str, hours: int) -> DataFrame:
    recent = since(calls, as_of, bounded(hours, 1, MAX_HOURS, "hours"))
    return recent.where(F.col("status") == SUCCESS)


def latency(
    calls: DataFrame, as_of: datetime | str, hours: int = 24, approx: bool = False
) -> DataFrame:
    """Successful calls per (provider, model): count and p50 / p95 / p99 of the
    latency and of the time to first token (NULL where no call has one)."""
    succeeded = _succeeded(calls, as_of, hours)
    measures = {"latency": "latency_ms", "ttft": "ttft_ms"}
    if approx:
        measured = approximate_quantiles(succeeded, MODEL_KEYS, measures)
    else:
        measured = exact_quantiles(succeeded, MODEL_KEYS, measures, null_keys=False)
    # every stored call has a latency, so its count is the number of calls
    report = measured.withColumnRenamed("n_latency", "n").drop("n_ttft")
    return report.orderBy(F.col("n").desc(), *MODEL_KEYS)


def throughput(calls: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Successful calls per (provider, model): output tokens per second of latency."""
    tokens, seconds = F.sum("output_tokens"), F.sum("latency_ms") / F.lit(1000.0)
    report = (
        _succeeded(calls, as_of, hours)
        .groupBy(*MODEL_KEYS)
        .agg(
            F.count("*").alias("n"),
            tokens.alias("total_output_tokens"),
            seconds.alias("total_latency_s"),
            F.when(seconds > 0, tokens / seconds)
            .otherwise(F.lit(0.0))
            .alias("tokens_per_second"),
        )
    )
    return report.orderBy(F.col("tokens_per_second").desc(), *MODEL_KEYS)


def status_by_hour(calls: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Calls per (hour, status), all statuses."""
    recent = since(calls, as_of, bounded(hours, 1, MAX_HOURS, "hours"))
    report = recent.groupBy(truncate("hour", F.col("created_at")).alias("hour"), "status").agg(
        F.count("*").alias("n")
    )
    return report.orderBy("hour", "status")


def cost_by_day(calls: DataFrame, as_of: datetime | str, days: int = 14) -> DataFrame:
    """Cost and calls per (UTC day, provider, model), all statuses."""
    recent = since(calls, as_of, 24 * bounded(days, 1, MAX_DAYS, "days"))
    report = recent.groupBy(F.col("created_at").cast("date").alias("day"), *MODEL_KEYS).agg(
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("cost_usd"), F.count("*").alias("n")
    )
    return report.orderBy("day", F.col("cost_usd").desc(), *MODEL_KEYS)


def session_activity(calls: DataFrame, limit: int = 50) -> DataFrame:
    """The sessions used last: calls, first and last instant, cost. No time bound."""
    report = calls.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("cost_usd"),
    )
    newest_first = (F.col("last_at").desc(), F.col("session_id"))
    return report.orderBy(*newest_first).limit(bounded(limit, 1, MAX_SESSIONS, "limit"))


SESSION_CALL_COLUMNS = (
    "id",
    "provider",
    "model",
    "status",
    "latency_ms",
    "ttft_ms",
    "input_tokens",
    "output_tokens",
    "total_cost",
    "created_at",
    "input_preview",
    "output_preview",
)


def session_calls(calls: DataFrame, session_id: str) -> DataFrame:
    """The calls of one session, oldest first."""
    mine = calls.where(F.col("session_id") == session_id)
    return mine.select(*SESSION_CALL_COLUMNS).orderBy("created_at", "id")


def kpis(calls: DataFrame, as_of: datetime | str, hours: int = 24, days: int = 14) -> DataFrame:
    """The dashboard's one-row summary, from a single scan of the longer window.

    ``calls`` counts successes only; ``error_rate_pct`` is errors over calls plus
    errors, but 0 whenever nothing succeeded. ``error_rate_all_pct`` uses the same
    quotient without that exception.
    """
    hours = bounded(hours, 1, MAX_HOURS, "hours")
    days = bounded(days, 1, MAX_DAYS, "days")
    longest = since(calls, as_of, max(hours, 24 * days))
    start = F.lit(str(as_of)).cast("timestamp_ntz")
    recent = F.col("created_at") >= start - F.make_dt_interval(hours=F.lit(hours))
    costed = F.col("created_at") >= start - F.make_dt_interval(days=F.lit(days))
    succeeded = F.col("status") == SUCCESS
    # models fold to one row each first, so counting them needs no distinct pass
    per_model = longest.groupBy("model").agg(
        F.count_if(recent & succeeded).alias("calls"),
        F.count_if(recent & ~succeeded).alias("errors"),
        F.sum(F.when(costed, F.col("total_cost"))).alias("cost_usd"),
    )
    totals = per_model.agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("calls") > 0).alias("models_active"),
    )
    ended = F.col("calls") + F.col("errors")
    rate = F.col("errors") / ended * F.lit(100.0)
    return totals.select(
        "calls",
        "errors",
        F.when(F.col("calls") > 0, rate).otherwise(F.lit(0.0)).alias("error_rate_pct"),
        F.when(ended > 0, rate).otherwise(F.lit(0.0)).alias("error_rate_all_pct"),
        "cost_usd",
        "models_active",
    )
