"""The hourly rollup, refreshed by what changed.

Every load names the hours its calls lie in, in a *change log* beside the call table. A
refresh takes the entries after the mark its last version noted, recomputes those hours from
the calls, carries the other hours of the same days over, and commits days and mark as one
version (``sources.snapshots``). So refreshes never run against each other, readers never
see half of one, and late calls cost the hours they fall into.

An entry is written after the calls it speaks of, and the log is read before the calls, so
an hour may be recomputed once too often but is never missed. Batches of a stream are
numbered upwards; removals are logged under a stream of their own.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.functions.instants import truncate, utc_literal
from callgauge.plans.rollup import WINDOW_DAYS, by_hour
from callgauge.session import materialize
from callgauge.sources import snapshots
from callgauge.sources.calls import BATCH, MONTH, STREAM, replace_batch

LOG_SCHEMA = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType(), True),
        T.StructField(STREAM, T.StringType(), False),
        T.StructField(BATCH, T.LongType(), False),
    ]
)


def log(calls: DataFrame, path: str, batch: int, stream: str) -> None:
    """Note the hours of a batch's calls; a repeated batch replaces its entries."""
    hours = calls.select(truncate("hour", F.col("created_at")).alias("hour")).distinct()
    replace_batch(hours, path, batch, stream)


def _entries(spark: SparkSession, path: str, marks: dict[str, int]) -> DataFrame:
    """Log entries after the marks; only the directories of newer batches are read."""
    try:
        entries = spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
    for stream, batch in marks.items():
        entries = entries.where((F.col(STREAM) != stream) | (F.col(BATCH) > batch))
    return entries


def hours_only(calls: DataFrame, hours: list[datetime]) -> DataFrame:
    """Calls of some hours; months are pruned, days narrow down to row groups."""
    days: dict = {}
    for hour in hours:
        days.setdefault(hour.date(), []).append(hour)
    wanted = F.lit(False)
    for same in days.values():
        first, last = F.lit(min(same)), F.lit(max(same))
        span = (F.col("created_at") >= first) & (
            F.col("created_at") < last + F.expr("INTERVAL 1 HOUR")
        )
        wanted |= span
    found = calls.where(wanted).where(truncate("hour", F.col("created_at")).isin(hours))
    if MONTH in calls.columns:
        found = found.where(F.col(MONTH).isin(sorted({d.replace(day=1) for d in days})))
    return found


def refresh(
    calls: DataFrame, changes: str, root: str, as_of: datetime | str, days: int = WINDOW_DAYS
) -> snapshots.Snapshot:
    """Bring the rollup at ``root`` up to date with the change log; returns its version.

    The first version computes the last ``days`` whole days before ``as_of``. Hours before
    that are left as they are, like those without changes. Raises ``snapshots.Conflict`` if
    another refresh was faster; that one has then done the work.
    """
    spark = calls.sparkSession
    base = snapshots.current(spark, root)
    marks = base.notes.get("marks", {})
    entries = materialize(_entries(spark, changes, marks))
    newest = entries.groupBy(STREAM).agg(F.max(BATCH).alias("batch")).collect()  # one per stream
    marks = {**marks, **{r[STREAM]: r["batch"] for r in newest}}
    start = truncate("day", utc_literal(as_of) - F.make_dt_interval(days=F.lit(days)))
    recent = F.col("hour") >= start
    if base.version:
        # at most 24 a day of the window and what lies after ``as_of``
        touched = entries.where(recent).select("hour").distinct().collect()
        hours = sorted(r["hour"] for r in touched)
        if not hours:
            return snapshots.commit(spark, base, base.parts, {**base.notes, "marks": marks})
        rows = by_hour(hours_only(calls, hours))
    else:
        hours = []
        bounded = calls.where(F.col("created_at") >= start)
        if MONTH in calls.columns:
            bounded = bounded.where(F.col(MONTH) >= F.trunc(start.cast("date"), "month"))
        rows = by_hour(bounded)
    fresh = rows.withColumn("version", F.lit(base.version + 1)).withColumn(
        "day", F.col("hour").cast("date")
    )
    changed = {h.date().isoformat() for h in hours}
    if base.version:
        kept = read(spark, base, changed & set(base.parts)).where(~F.col("hour").isin(hours))
        fresh = fresh.unionByName(kept)
    folder = snapshots.write(fresh, root, "day")
    schema = T.StructType(fresh.schema.fields)
    stored = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{folder}")
    there = {str(r["day"]) for r in stored.select("day").distinct().collect()}  # days of the window
    parts = {d: f for d, f in base.parts.items() if d not in changed}
    parts |= dict.fromkeys(sorted(there), folder)
    return snapshots.commit(
        spark, base, parts, {"marks": marks, "schema": schema.jsonValue(), "as_of": str(as_of)}
    )


def read(
    spark: SparkSession, snapshot: snapshots.Snapshot, wanted: set[str] | None = None
) -> DataFrame:
    """The rollup of a version; ``version`` tells when a row was last computed."""
    schema = T.StructType.fromJson(snapshot.notes["schema"])
    return snapshots.read(spark, snapshot, schema, wanted)
