"""The hourly rollup kept up to date by a stream.

An hour is emitted once the watermark has passed its end, the last ones of a stream that
ends by ``closing.mark``. State per group is a few
sums and two sketches of bounded size, however many calls the hour has; exact
percentiles come from the batch rollup, whose refresh also absorbs calls later than
the watermark.

``write_fresh`` does without a watermark: every batch stores its own partial sums, and
``fresh`` adds up whatever is there. Hours that are still open show at once, calls of any
lateness count, and a repeated batch replaces its own partials. There is no state to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.plans.rollup import KEYS, SKETCHES, SUMS, sketches, sums_by_hour, totals
from callgauge.sources.calls import BATCH, COMPACTED, STREAM, replace_batch
from callgauge.streaming.load import stream_id


def rollup_stream(calls: DataFrame, delay: str = "1 hour", with_sketches: bool = True) -> DataFrame:
    """Streaming aggregate with the rollup's columns."""
    timed = calls.withColumn("event_time", F.col("created_at").cast("timestamp"))
    grouped = timed.withWatermark("event_time", delay).groupBy(
        F.window("event_time", "1 hour").alias("_hour"), "provider", "model", "status"
    )
    rows = grouped.agg(*totals(), *(sketches() if with_sketches else []))
    hour = F.col("_hour.start").cast("timestamp_ntz").alias("hour")
    return rows.select(hour, *[c for c in rows.columns if c != "_hour"])


def write(
    rollup: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append finished hours to a Parquet table, each exactly once."""
    writer = (
        rollup.withColumn("day", F.col("hour").cast("date"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def store_partials(calls: DataFrame, path: str, batch: int, stream: str) -> None:
    """One batch's share of every hour it touches; replaces what the batch stored before."""
    replace_batch(sums_by_hour(calls), path, batch, stream)


def write_fresh(
    calls: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store the partials of every micro-batch of a stream of calls."""

    def handle(batch: DataFrame, number: int) -> None:
        store_partials(batch, path, number, stream_id(batch.sparkSession, checkpoint))

    writer = calls.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _merged() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.kll_merge_agg_double(c).alias(c) for c in SKETCHES],
    ]


def fresh(spark: SparkSession, path: str) -> DataFrame:
    """The rollup as of the last batch: sums, and sketches for ``rollup.reaggregate``."""
    return spark.read.parquet(path).groupBy(*KEYS).agg(*_merged())


def fold(spark: SparkSession, path: str, target: str) -> None:
    """Copy partials to the fresh folder ``target``, settled batches added up to one.

    The newest batch of every stream stays apart, since the stream may repeat it; streams
    then go on with the copy. The source is left as it is.
    """
    stored = spark.read.parquet(path)
    newest = stored.groupBy(STREAM).agg(F.max(BATCH).alias("_newest"))
    settled = F.col(BATCH) < F.col("_newest")
    named = stored.join(newest, STREAM).withColumns(
        {
            STREAM: F.when(settled, F.lit(COMPACTED)).otherwise(F.col(STREAM)),
            BATCH: F.when(settled, F.lit(0)).otherwise(F.col(BATCH)).cast("bigint"),
        }
    )
    merged = named.groupBy(*KEYS, STREAM, BATCH).agg(*_merged())
    merged.write.mode("errorifexists").partitionBy(STREAM, BATCH).parquet(target)
