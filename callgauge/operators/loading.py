"""From checked feed rows to the call table and the dead-letter table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.functions.instants import month_of
from callgauge.functions.redaction import redact, replace_spans
from callgauge.operators import validation
from callgauge.schema import CALL_COLUMNS, CALLS_SCHEMA, MAX_LOAD_ATTEMPTS, RECORD_FIELDS
from callgauge.sources.calls import MONTH, in_declared_months

PREVIEWS = ("input_preview", "output_preview")
# what the table accepts at most once; the narrower choice is ("id",)
TABLE_KEY = ("id", "created_at")
DUPLICATE = "id:duplicate"
NO_PARTITION = "created_at:no_partition"
FAILED = "row:failed"
FAILURES = "failures"


def to_calls(
    good: DataFrame,
    redact_columns: Sequence[str] = PREVIEWS,
    entities: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Stored columns in table order, with renames and redacted previews.

    ``entities``, such as ``plugins.span_finder``, returns the entity spans of a text; it
    sees the previews after the rules and its spans are replaced as well. With one that
    reports failures, such as ``plugins.guarded_span_finder``, rows carry ``failures``: one
    ``<column>:<error>`` per preview it failed on; see ``failed``.
    The feed's own columns (``origin_id``, ``payload``, ``arrived_at``) stay in
    front, so a row that is refused later still carries its original payload.
    """
    columns = {}
    for field in RECORD_FIELDS:
        value = F.col("record")[field.name]
        if field.stored in redact_columns:
            value = redact(value)
        columns[field.stored] = value.cast(CALLS_SCHEMA[field.stored].dataType)
    feed = [c for c in good.columns if c not in ("record", "errors")]
    rows = good.select(*feed, *[columns[c].alias(c) for c in CALL_COLUMNS])
    return rows if entities is None else mask_entities(rows, entities, redact_columns)


def mask_entities(
    rows: DataFrame,
    entities: Callable[[Column], Column],
    redact_columns: Sequence[str] = PREVIEWS,
) -> DataFrame:
    """The entity step of ``to_calls``, on rows the rules have been applied to."""
    spans = {f"_spans_{c}": entities(F.col(c)) for c in redact_columns}
    found = rows.withColumns(spans)
    guarded = [c for c in redact_columns if _is_guarded(found.schema[f"_spans_{c}"].dataType)]
    places = {c: F.col(f"_spans_{c}.spans" if c in guarded else f"_spans_{c}") for c in redact_columns}
    masked = {c: replace_spans(F.col(c), places[c]) for c in redact_columns}
    if guarded:
        errors = [
            F.when(F.col(f"_spans_{c}.error").isNotNull(), F.concat_ws(":", F.lit(c), f"_spans_{c}.error"))
            for c in guarded
        ]
        masked[FAILURES] = F.array_compact(F.array(*errors))
    return found.withColumns(masked).drop(*spans)


def _is_guarded(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"spans", "error"} <= set(kind.names)


def failed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters): rows a plug-in failed on are letters that are not tried again.

    The plug-in has had its attempts on them, so theirs count as used up.
    """
    whole = rows.where(F.size(FAILURES) == 0).drop(FAILURES)
    return whole, exhausted(rows.where(F.size(FAILURES) > 0), F.col(FAILURES))


def exhausted(rows: DataFrame, errors: Column) -> DataFrame:
    """Dead letters that ``retryable`` leaves alone once they are stored."""
    return rows.select(
        "origin_id",
        "payload",
        "arrived_at",
        F.lit(MAX_LOAD_ATTEMPTS - 1).alias("attempts"),
        errors.alias("errors"),
    )


def first_arrivals(rows: DataFrame, key: Sequence[str] = TABLE_KEY) -> DataFrame:
    """Mark every row with its position among the copies of the same key.

    Adds ``copy`` (1 = earliest arrival).
    """
    order = W.partitionBy(*key).orderBy("arrived_at", "origin_id")
    return rows.withColumn("copy", F.row_number().over(order))


def new_rows(
    rows: DataFrame, stored: DataFrame | None = None, key: Sequence[str] = TABLE_KEY
) -> DataFrame:
    """The earliest copy of every key that is not stored yet.

    Only the first of each key's copies leaves a map task, so a key with very many
    copies does not gather in one reducer.
    """
    first = first_arrivals(rows, key).where(F.col("copy") == 1).drop("copy")
    return first if stored is None else first.join(stored.select(*key), list(key), "left_anti")


def duplicates(
    rows: DataFrame, stored: DataFrame | None = None, key: Sequence[str] = TABLE_KEY
) -> DataFrame:
    """The rows ``new_rows`` leaves out, as dead letters.

    The earliest copy per key is an aggregate that is combined before the exchange.
    Every row is then compared with it, so copies are never gathered by key.
    """
    stamp = F.struct("arrived_at", "origin_id")
    winners = rows.groupBy(*key).agg(F.min(stamp).alias("_winner"))
    if stored is not None:
        seen = stored.select(*key).withColumn("_stored", F.lit(True))
        winners = winners.join(seen, list(key), "left")
    else:
        winners = winners.withColumn("_stored", F.lit(None).cast("boolean"))
    loses = F.col("_stored").isNotNull() | (stamp != F.col("_winner"))
    return as_dead(rows.join(winners, list(key)).where(loses), DUPLICATE)


def as_dead(rows: DataFrame, reason: str) -> DataFrame:
    """Dead letters for rows that were good records but cannot be stored."""
    kept = [c for c in ("origin_id", "payload", "arrived_at", "attempts") if c in rows.columns]
    return rows.select(*kept, F.array(F.lit(reason)).alias("errors"))


def route(rows: DataFrame, first_month: date | str, months: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead): rows inside and outside the declared month partitions."""
    inside = in_declared_months(F.col("created_at"), first_month, months)
    return rows.where(inside), as_dead(rows.where(~inside), NO_PARTITION)


def retryable(dead_letters: DataFrame, max_attempts: int = MAX_LOAD_ATTEMPTS) -> DataFrame:
    """Dead letters that may be tried again, as feed rows that remember their attempts."""
    again = dead_letters.where(F.col("attempts") < max_attempts)
    return again.select("origin_id", "payload", "arrived_at", "attempts")


def replay(dead_letters: DataFrame) -> DataFrame:
    """Check dead letters again, e.g. after a rule was relaxed; see ``validation.check``.

    Their attempts go on counting.
    """
    kept = [c for c in ("origin_id", "payload", "arrived_at", "attempts") if c in dead_letters.columns]
    return validation.check(dead_letters.select(*kept))


def months_touched(rows: DataFrame) -> DataFrame:
    """Distinct month partitions of a batch."""
    return rows.select(month_of(F.col("created_at")).alias(MONTH)).distinct()


def instants_touched(rows: DataFrame) -> DataFrame:
    """Per month partition of a batch: its first and last instant."""
    return rows.groupBy(month_of(F.col("created_at")).alias(MONTH)).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last")
    )
