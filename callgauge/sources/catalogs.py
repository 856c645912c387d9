"""Small fixed tables. They are literal relations, so Spark knows their exact size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from callgauge.schema import MODEL_REGISTRY, PRICES, TURN_CAPS


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def _values(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def prices(spark: SparkSession) -> DataFrame:
    """(provider, model, input_per_1k, output_per_1k)"""
    return _values(spark, ["provider", "model", "input_per_1k", "output_per_1k"], PRICES)


def numbered_prices(spark: SparkSession) -> DataFrame:
    """The price catalog with each entry's position, starting at 0."""
    rows = [(i, *entry) for i, entry in enumerate(PRICES)]
    return _values(
        spark, ["entry", "provider", "model", "input_per_1k", "output_per_1k"], rows
    )


def turn_caps(spark: SparkSession) -> DataFrame:
    """(model, cap)"""
    return _values(spark, ["model", "cap"], TURN_CAPS.items())


def registry(spark: SparkSession) -> DataFrame:
    """(provider, model) pairs a chat request may name."""
    rows = [(provider, model) for provider, models in MODEL_REGISTRY.items() for model in models]
    return _values(spark, ["provider", "model"], rows)
