"""The call table: Parquet, one directory per month of ``created_at``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.functions.instants import date_literal, month_of, utc_literal
from callgauge.schema import CALL_COLUMNS, CALLS_SCHEMA
from callgauge.sources.layout import z_key

MONTH = "created_month"
STREAM = "load_stream"
BATCH = "load_batch"
# the stream that settled batches belong to after ``compact``
COMPACTED = "compacted"
# what reports filter by: time, model, session
CLUSTER_BY = ("created_at", "model", "session_id")
STORED_SCHEMA = T.StructType(
    [
        *CALLS_SCHEMA.fields,
        T.StructField(MONTH, T.DateType(), False),
        T.StructField(STREAM, T.StringType(), False),
        T.StructField(BATCH, T.LongType(), False),
    ]
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored calls, with their partition columns.

    The schema is given, never inferred, so opening the table reads no footers.
    """
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def read_months(spark: SparkSession, path: str, months: list[date]) -> DataFrame | None:
    """The stored calls of some months, None if there are none.

    Only the directories of these months are listed, so opening them costs the same
    however many batches other months have taken in.
    """
    found = []
    for month in sorted(months):
        try:
            found.append(
                spark.read.schema(STORED_SCHEMA)
                .option("basePath", path)
                .parquet(f"{path.rstrip('/')}/{MONTH}={month.isoformat()}")
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, found) if found else None


def since(calls: DataFrame, as_of: datetime | str, hours: int) -> DataFrame:
    """Calls created at or after ``as_of`` minus ``hours``.

    On a month-partitioned table the implied partition predicate is added, because
    pruning works on the partition column only.
    """
    start = utc_literal(as_of) - F.make_dt_interval(hours=F.lit(hours))
    bounded = calls.where(F.col("created_at") >= start)
    if MONTH in calls.columns:
        bounded = bounded.where(F.col(MONTH) >= month_of(start))
    return bounded


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value


def lookup(calls: DataFrame, call_id: str) -> DataFrame:
    """The stored row of one call id; the filter reaches the Parquet scan."""
    return calls.where(F.col("id") == call_id)


def project(calls: DataFrame, *columns: str) -> DataFrame:
    """Ad-hoc projection; by default the four columns most often asked for."""
    return calls.select(*(columns or ("provider", "model", "latency_ms", "total_cost")))


def append(calls: DataFrame, path: str, batch: int, stream: str) -> None:
    """Write one load batch of one stream.

    Every batch of a stream owns a directory below each month it touches and replaces
    only those directories, so a repeated batch leaves the table as if it ran once, and
    batches of the same number from other streams stay.
    Rows are sorted by (provider, model, created_at) inside each file, which keeps
    the row-group statistics narrow for the dashboard filters.
    """
    (
        calls.select(*CALL_COLUMNS, month_of(F.col("created_at")).alias(MONTH))
        .withColumn(STREAM, F.lit(stream))
        .withColumn(BATCH, F.lit(batch).cast("bigint"))
        .sortWithinPartitions(MONTH, "provider", "model", "created_at")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy(MONTH, STREAM, BATCH)
        .parquet(path)
    )


def replace_batch(rows: DataFrame, path: str, batch: int, stream: str) -> None:
    """Store rows by (stream, batch) in any table; a repeated batch replaces its own."""
    (
        rows.withColumn(STREAM, F.lit(stream))
        .withColumn(BATCH, F.lit(batch).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(STREAM, BATCH)
        .parquet(path)
    )


_COMMITS = T.StructType(
    [
        T.StructField("committed", T.BooleanType(), True),
        T.StructField(STREAM, T.StringType(), False),
        T.StructField(BATCH, T.LongType(), False),
    ]
)


def commit(spark: SparkSession, path: str, batch: int, stream: str) -> None:
    """Note that all tables of a load batch are written; one row, one file."""
    replace_batch(spark.range(1).select(F.lit(True).alias("committed")), path, batch, stream)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(load_stream, load_batch) of the batches that were noted."""
    try:
        return spark.read.schema(_COMMITS).parquet(path).where("committed").select(STREAM, BATCH)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS).select(STREAM, BATCH)


def is_committed(spark: SparkSession, path: str, batch: int, stream: str) -> bool:
    own = (F.col(STREAM) == stream) & (F.col(BATCH) == batch)
    return not commits(spark, path).where(own).isEmpty()


def visible(rows: DataFrame, noted: DataFrame) -> DataFrame:
    """Rows of a loaded table, calls or dead letters, whose batch is complete.

    Take ``noted`` (``commits``) once for all tables of one report, so that they agree.
    """
    done = noted.unionByName(
        noted.sparkSession.createDataFrame([(COMPACTED, 0)], noted.schema)
    ).distinct()
    return rows.join(done, [STREAM, BATCH], "left_semi").select(rows.columns)


def settled(stored: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the owner of stored rows; all but a stream's newest batch become one."""
    newest = stored.groupBy(STREAM).agg(F.max(BATCH).alias("_newest"))
    older = F.col(BATCH) < F.col("_newest")
    # one row a stream; joined by shuffle, all rows of a stream would meet in one task
    return stored.join(F.broadcast(newest), STREAM).select(
        *columns,
        F.when(older, F.lit(COMPACTED)).otherwise(F.col(STREAM)).alias(STREAM),
        F.when(older, F.lit(0)).otherwise(F.col(BATCH)).cast("bigint").alias(BATCH),
    )


def compact(
    spark: SparkSession, path: str, target: str, cluster_by: Sequence[str] = (), **options: str
) -> None:
    """Copy the table at ``path`` to the fresh folder ``target`` with few files a month.

    Adaptive execution sizes the files (``advisoryPartitionSizeInBytes``) and splits
    months that hold much.

    The newest batch of every stream keeps its own directories, because a stream may
    still repeat it; older ones are settled and become one. Streams then go on with
    ``target`` under their old checkpoints. The source stays as it is, so a copy that
    fails is thrown away and made again.

    Files are sorted by (provider, model, created_at). With ``cluster_by``, such as
    ``CLUSTER_BY``, months are cut into files by a Z-order key of these columns instead, so
    that a filter on any of them skips files and row groups. ``options`` go to the Parquet
    writer, for instance ``parquet.block.size`` for smaller row groups.
    """
    stored = read(spark, path)
    named = settled(stored, *CALL_COLUMNS, MONTH)
    if cluster_by:
        keyed = named.withColumn("_z", z_key(stored, cluster_by))
        # the id cuts places that hold many rows
        order = [MONTH, STREAM, BATCH, "_z", "id"]
        dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_z")
    else:
        dealt = named.hint("rebalance", MONTH, STREAM, BATCH).sortWithinPartitions(
            MONTH, STREAM, BATCH, "provider", "model", "created_at"
        )
    (
        dealt.write.mode("errorifexists")
        .options(**options)
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy(MONTH, STREAM, BATCH)
        .parquet(target)
    )


def month_bounds(months: DataFrame, column: str = "month", prefix: str = "calls") -> DataFrame:
    """(name, lower, upper) of the month partition that holds each date; half-open."""
    lower = F.trunc(F.col(column), "month")
    return months.select(
        F.concat(F.lit(f"{prefix}_"), F.date_format(lower, "yyyy_MM")).alias("name"),
        lower.alias("lower"),
        F.add_months(lower, 1).cast("date").alias("upper"),
    )


def months_forward(starts: DataFrame, column: str, count: int) -> DataFrame:
    """For each start date, ``count`` consecutive months from the one holding it."""
    first = F.trunc(F.col(column), "month")
    last = F.add_months(first, count - 1)
    month = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    return starts.select(month.alias("month"))


def in_declared_months(created_at: Column, first: date | str, count: int) -> Column:
    """Whether an instant falls into one of ``count`` months starting at ``first``."""
    lower = F.trunc(date_literal(first), "month")
    upper = F.add_months(lower, count)
    return (created_at >= lower.cast("timestamp_ntz")) & (
        created_at < upper.cast("timestamp_ntz")
    )
