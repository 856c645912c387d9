"""Instants as zone-free UTC timestamps."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
ISO_INSTANT = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)
# --- end of fixed values ----------------------------------------------------------


def utc_literal(instant: datetime | str) -> Column:
    """A literal instant; a datetime with an offset is converted to UTC."""
    if isinstance(instant, str):
        instant = datetime.fromisoformat(instant)
    if instant.tzinfo is not None:
        instant = instant.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(instant.isoformat(sep=" ")).cast("timestamp_ntz")


def date_literal(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")


def to_utc(instant: Column) -> Column:
    """Zone-free UTC value of a TIMESTAMP column, whatever the session zone is."""
    return F.timestamp_add(
        "MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def instant_sql(text: str) -> str:
    """SQL that parses an upper-case ISO-8601 date, or date and time with or without
    offset (none means UTC), to zone-free UTC; NULL when the text is no such instant."""
    offset = f"substring({text}, 17, 1)"
    # an offset right after the minutes: Spark wants the seconds written out
    seconds = f"CASE WHEN {offset} = ':' THEN {text} ELSE left({text}, 16) || ':00' || substring({text}, 17) END"
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return (
        f"CASE WHEN NOT {text} RLIKE '{ISO_INSTANT}' THEN NULL "
        f"WHEN substring({text}, 17) RLIKE '[Z+-]' THEN "
        f"timestampadd(MICROSECOND, unix_micros(try_to_timestamp({seconds})), {epoch}) "
        f"ELSE try_cast({text} AS TIMESTAMP_NTZ) END"
    )


def iso(instant: Column) -> Column:
    """ISO-8601 text of an instant, as feed payloads carry it."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, with microsecond precision."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000.0)


def truncate(unit: str, instant: Column) -> Column:
    """Start of the hour / day / month, kept zone-free."""
    return F.date_trunc(unit, instant).cast("timestamp_ntz")


def month_of(instant: Column) -> Column:
    """First day of the month: the partition value of the call table."""
    return F.trunc(instant.cast("date"), "month")
