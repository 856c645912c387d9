"""Pricing of calls from the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.metadata import flag_if
from callgauge.sources import catalogs

COST_UNITS = 1e8


def call_cost(
    input_tokens: Column, output_tokens: Column, input_per_1k: Column, output_per_1k: Column
) -> Column:
    """USD, rounded half up to whole units of 1e-8."""
    cost = input_tokens / F.lit(1000.0) * input_per_1k + output_tokens / F.lit(1000.0) * output_per_1k
    return F.round(cost * COST_UNITS) / COST_UNITS


def with_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``total_cost`` and ``cost_missing``.

    A (provider, model) without a price costs 0 and is marked missing. The built-in
    catalog has a fixed 24 rows and is broadcast; a catalog passed in is joined as
    its size demands.
    """
    catalog = F.broadcast(catalogs.prices(calls.sparkSession)) if prices is None else prices
    rates = catalog.select(
        "provider", "model", F.col("input_per_1k").alias("_in"), F.col("output_per_1k").alias("_out")
    )
    cost = call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("_in"), F.col("_out"))
    kept = [c for c in calls.columns if c not in ("total_cost", "cost_missing")]
    return calls.join(rates, ["provider", "model"], "left").select(
        *kept,
        F.coalesce(cost, F.lit(0.0)).alias("total_cost"),
        F.col("_in").isNull().alias("cost_missing"),
    )


def flag_missing_cost(calls: DataFrame) -> DataFrame:
    """Record ``cost_missing`` in the metadata of the calls it applies to."""
    return calls.withColumn(
        "metadata", flag_if(F.col("metadata"), "cost_missing", F.col("cost_missing"))
    )
