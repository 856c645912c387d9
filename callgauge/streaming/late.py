"""Late rows of a stream, told apart instead of dropped.

A watermarked operator drops rows behind its watermark without a word. ``split_stream`` keeps
the same mark itself: the newest instant of all earlier batches less the delay. Rows before
it go to a table of their own, with the mark and by how much they missed it; the others go to
the handler. Each batch's mark is stored under its number, so a batch that is repeated after
a failure, or a stream that is started again, makes the same decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from callgauge.sources.calls import BATCH, STREAM, replace_batch
from callgauge.streaming.load import stream_id

MARKS = T.StructType(
    [
        T.StructField("newest", T.TimestampNTZType(), True),
        T.StructField(STREAM, T.StringType(), False),
        T.StructField(BATCH, T.LongType(), False),
    ]
)


def _mark(spark: SparkSession, path: str, stream: str, batch: int):
    """The newest instant of the stream's earlier batches."""
    try:
        marks = spark.read.schema(MARKS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    earlier = marks.where((F.col(STREAM) == stream) & (F.col(BATCH) < batch))
    return earlier.agg(F.max("newest").alias("newest")).first()["newest"]


def split_batch(
    rows: DataFrame, column: str, delay: str, path: str, batch: int, stream: str
) -> tuple[DataFrame, DataFrame]:
    """(on time, late); late rows have ``watermark`` and ``late_by_us`` as well.

    Rows without an instant are on time. Stores nothing; see ``note``.
    """
    newest = _mark(rows.sparkSession, f"{path}/marks", stream, batch)
    watermark = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
    late = F.coalesce(F.col(column) < watermark, F.lit(False))
    missed = rows.where(late).withColumns(
        {
            "watermark": watermark,
            "late_by_us": F.timestamp_diff("MICROSECOND", F.col(column), watermark),
        }
    )
    return rows.where(~late), missed


def note(rows: DataFrame, column: str, path: str, batch: int, stream: str) -> None:
    """Store the newest instant of a batch for the batches after it."""
    newest = rows.agg(F.max(column).alias("newest"))
    replace_batch(newest, f"{path}/marks", batch, stream)


def split_stream(
    rows: DataFrame,
    column: str,
    delay: str,
    path: str,
    checkpoint: str,
    on_time: Callable[[DataFrame, int, str], None],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``on_time(rows, batch, stream)`` on what is in time, store the rest at ``path``.

    ``column`` is a TIMESTAMP_NTZ. The handler should write by (stream, batch), replacing
    what it wrote for that batch before, as ``streaming.load.load_batch`` does.
    """

    def handle(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            timely, missed = split_batch(batch, column, delay, path, number, stream)
            on_time(timely, number, stream)
            replace_batch(missed, f"{path}/late", number, stream)
            note(batch, column, path, number, stream)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The late rows of a stream whose rows have ``schema``."""
    extra = [
        T.StructField("watermark", T.TimestampNTZType(), True),
        T.StructField("late_by_us", T.LongType(), True),
        T.StructField(STREAM, T.StringType(), True),
        T.StructField(BATCH, T.LongType(), True),
    ]
    return spark.read.schema(T.StructType([*schema.fields, *extra])).parquet(f"{path}/late")
