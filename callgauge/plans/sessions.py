"""Session activity kept up to date by the loads, answered without a scan of the calls.

Every batch stores its share of each session it touches, and apart from that its *frontier*:
the sessions of the batch with the newest last call. A session that is among the newest of
the table has its newest call in some batch, and there it is among the newest too; so the
union of the frontiers holds every answer, and only the sessions picked from it are added up.
A repeated batch replaces its own share; calls may come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.sources.calls import BATCH, COMPACTED, STREAM, bounded, replace_batch

MOST = 1000  # sessions of a batch's frontier, the most a report may ask for


def _order() -> list[Column]:
    return [F.col("last_at").desc(), F.col("session_id")]


def store_batch(calls: DataFrame, path: str, batch: int, stream: str) -> None:
    """One batch's share of its sessions; replaces what the batch stored before."""
    shares = calls.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("cost_usd"),
    )
    shares_path = f"{path.rstrip('/')}/shares"
    replace_batch(shares, shares_path, batch, stream)
    own = (F.col(STREAM) == stream) & (F.col(BATCH) == batch)
    stored = calls.sparkSession.read.parquet(shares_path).where(own)
    frontier = stored.orderBy(*_order()).limit(MOST).select("session_id", "last_at")
    replace_batch(frontier, f"{path.rstrip('/')}/frontier", batch, stream)


def _merged(shares: DataFrame, *keys: str) -> DataFrame:
    return shares.groupBy("session_id", *keys).agg(
        F.sum("n").alias("n"),
        F.min("started_at").alias("started_at"),
        F.max("last_at").alias("last_at"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def activity(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The most recently used sessions; as ``reports.session_activity``."""
    limit = bounded(limit, 1, MOST, "limit")
    newest = (
        spark.read.parquet(f"{path.rstrip('/')}/frontier")
        .groupBy("session_id")
        .agg(F.max("last_at").alias("last_at"))
        .orderBy(*_order())
        .limit(limit)
    )
    shares = spark.read.parquet(f"{path.rstrip('/')}/shares")
    picked = F.broadcast(newest.select(F.col("session_id").alias("picked")))  # at most MOST rows
    mine = shares.join(picked, F.col("session_id").eqNullSafe(F.col("picked"))).drop("picked")
    return _merged(mine).orderBy(*_order())


def fold(spark: SparkSession, path: str, target: str) -> None:
    """Copy to the fresh folder ``target``, settled batches added up to one.

    The newest batch of every stream stays apart, since the stream may repeat it.
    """
    shares = spark.read.parquet(f"{path.rstrip('/')}/shares")
    newest = shares.groupBy(STREAM).agg(F.max(BATCH).alias("_newest"))
    settled = F.col(BATCH) < F.col("_newest")
    named = shares.join(newest, STREAM).withColumns(
        {
            STREAM: F.when(settled, F.lit(COMPACTED)).otherwise(F.col(STREAM)),
            BATCH: F.when(settled, F.lit(0)).otherwise(F.col(BATCH)).cast("bigint"),
        }
    )
    folder = target.rstrip("/")
    _merged(named, STREAM, BATCH).write.mode("errorifexists").partitionBy(STREAM, BATCH).parquet(
        f"{folder}/shares"
    )
    merged = spark.read.parquet(f"{folder}/shares")
    places = [tuple(r) for r in merged.select(STREAM, BATCH).distinct().collect()]  # few
    for stream, batch in places:
        own = (F.col(STREAM) == stream) & (F.col(BATCH) == batch)
        frontier = merged.where(own).orderBy(*_order()).limit(MOST)
        replace_batch(frontier.select("session_id", "last_at"), f"{folder}/frontier", batch, stream)
