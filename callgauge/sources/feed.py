"""The telemetry feed: rows of (origin_id, payload, arrived_at)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress

from callgauge.functions.instants import to_utc, utc_literal
from callgauge.schema import BACKLOG_LIMIT, FEED_SCHEMA


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A bounded feed stored as files."""
    return spark.read.schema(FEED_SCHEMA).format(fmt).load(path)


def stream_files(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, schema=None
) -> DataFrame:
    """An unbounded feed that grows by files; ``max_files`` bounds each micro-batch."""
    reader = spark.readStream.schema(schema or FEED_SCHEMA).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets: int | None = None,
    starting: str = "latest",
) -> DataFrame:
    """An unbounded feed from a topic whose values are the payloads.

    A new query starts at the end of the topic; a restarted one continues from its
    checkpoint. Needs Spark's Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return from_topic(reader.load())


def from_topic(records: DataFrame) -> DataFrame:
    """Feed rows from the columns a topic delivers."""
    return records.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("origin_id"),
        F.col("value").cast("string").alias("payload"),
        to_utc(F.col("timestamp")).alias("arrived_at"),
    )


def unprocessed(
    feed: DataFrame, processed: DataFrame, as_of=None, idle_seconds: int = 60
) -> DataFrame:
    """Feed rows no load has accounted for, optionally only those idle long enough.

    ``processed`` lists the ``origin_id`` of every loaded or dead-lettered row.
    """
    pending = feed.join(processed.select("origin_id"), "origin_id", "left_anti")
    if as_of is None:
        return pending
    idle_since = utc_literal(as_of) - F.make_dt_interval(secs=F.lit(idle_seconds))
    return pending.where(F.col("arrived_at") <= idle_since)


def counters(
    feed: DataFrame, processed: DataFrame, dead: DataFrame, limit: int = BACKLOG_LIMIT
) -> DataFrame:
    """One row: rows waiting, dead letters, and whether new rows should be refused."""
    waiting = unprocessed(feed, processed).select(F.lit(1).alias("w"), F.lit(0).alias("d"))
    letters = dead.select(F.lit(0).alias("w"), F.lit(1).alias("d"))
    totals = waiting.unionAll(letters).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("feed_len"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("dead_len"),
    )
    return totals.withColumn("saturated", F.col("feed_len") >= limit)


def lag(progress: StreamingQueryProgress) -> int | None:
    """Rows a running stream has yet to read, from a progress report of its query.

    Sums, over the partitions of its topics, the newest offset less the one read so far.
    None when a source does not report its newest offset, as files do not.
    """
    waiting = 0
    for source in json.loads(progress.json)["sources"]:
        newest, done = source.get("latestOffset"), source.get("endOffset") or {}
        if not isinstance(newest, dict):
            return None
        waiting += sum(
            offset - done.get(topic, {}).get(part, 0)
            for topic, parts in newest.items()
            for part, offset in parts.items()
        )
    return waiting
