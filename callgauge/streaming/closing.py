"""The end of a stream that was drained for good.

Groups wait for the watermark, and the watermark waits for later rows, so the last hours
and calls of a stream that ends would stay in its state. A *mark*, one row whose only
value is an instant far ahead, moves the watermark past all of them. It is read from a
folder beside the real source, and only written once that source was drained: the query
is started again under its checkpoint, reads the mark and emits what was left. The mark's
own group never closes, so it is in no result. Rows that arrive after it are late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "9999-01-01 00:00:00"


def with_marks(rows: DataFrame, path: str) -> DataFrame:
    """The rows of a stream and the marks of the folder ``path``.

    Put it in front of the operator that sets the watermark.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))


def mark(
    spark: SparkSession, schema: T.StructType, path: str, column: str, at: str = END
) -> None:
    """Write a mark into ``path`` whose instant is in ``column``."""
    values = [
        (F.lit(at) if f.name == column else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    spark.range(1).select(*values).write.mode("append").parquet(path)
