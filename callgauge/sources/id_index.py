"""Where the call table holds an id: hash buckets of ids, each with a Bloom filter.

Ids are random, so neither months nor file statistics tell where one lies. Every load adds the
ids it stores to buckets by a hash of the id, and to a filter that is a table as well: one row
per 64-bit word in use, probed by a join. Ids the filter does not know are surely new and need
no comparison; for the others only their buckets are opened, so a wrong guess of the filter
costs time and never a row.

A batch owns its folders as in the call table: repeating it replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.functions.instants import month_of
from callgauge.session import materialize
from callgauge.sources import calls as call_table
from callgauge.sources.calls import BATCH, MONTH, STREAM

BUCKET, WORD, BITS = "id_bucket", "word", "bits"
IDS, FILTER = "ids", "filter"
# bits set per id, all in one word: with 16 bits of filter an id about one in 150 new ids is
# taken for a known one
PROBES = 4

_OWNER = [T.StructField(STREAM, T.StringType(), False), T.StructField(BATCH, T.LongType(), False)]
_SCHEMAS = {
    IDS: T.StructType(
        [
            T.StructField("id", T.StringType(), False),
            T.StructField("created_at", T.TimestampNTZType(), False),
            T.StructField(BUCKET, T.IntegerType(), False),
            *_OWNER,
        ]
    ),
    FILTER: T.StructType(
        [
            T.StructField(WORD, T.LongType(), False),
            T.StructField(BITS, T.LongType(), False),
            T.StructField(BUCKET, T.IntegerType(), False),
            *_OWNER,
        ]
    ),
}


@dataclass(frozen=True)
class Index:
    """Where an index lies and how it is cut; both counts are fixed for its life.

    ``words`` is the size of a bucket's filter. Only words in use are stored, so a generous
    number costs nothing; beyond four ids a word more ids are compared than need be.
    """

    root: str
    buckets: int = 64
    words: int = 1 << 24

    def path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"


def _bucket(index: Index) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(index.buckets)).cast("int").alias(BUCKET)


def _probe(index: Index) -> tuple[Column, Column]:
    """(word, bits) of an id in the filter of its bucket."""
    word = F.pmod(F.xxhash64("id", F.lit("word")), F.lit(index.words))
    draw = F.xxhash64("id", F.lit("bits"))
    bits = [
        F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.shiftright(draw, 6 * n).bitwiseAND(63).cast("int")
        )
        for n in range(PROBES)
    ]
    return word.alias(WORD), reduce(Column.bitwiseOR, bits).alias(BITS)


def _store(rows: DataFrame, path: str, order: str, mode: str = "overwrite") -> None:
    """Write rows by bucket and owner; sorted, so that statistics of row groups are narrow."""
    (
        rows.hint("rebalance", BUCKET)
        .sortWithinPartitions(BUCKET, STREAM, BATCH, order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy(BUCKET, STREAM, BATCH)
        .parquet(path)
    )


def _read(spark: SparkSession, index: Index, part: str, buckets: list[int] | None) -> DataFrame | None:
    """One part of the index, of some buckets; folders of the others are not even listed."""
    path = index.path(part)
    if buckets is not None and not buckets:
        return None
    wanted = path if buckets is None else f"{path}/{BUCKET}={{{','.join(map(str, buckets))}}}"
    try:
        return spark.read.schema(_SCHEMAS[part]).option("basePath", path).parquet(wanted)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # none of the buckets has been written to


def _buckets_of(df: DataFrame) -> list[int]:
    """The distinct buckets of some rows; no more than the index has."""
    return sorted(r[BUCKET] for r in df.select(BUCKET).distinct().collect())


def _filter_of(index: Index, ids: DataFrame) -> DataFrame:
    word, bits = _probe(index)
    probes = ids.select(BUCKET, STREAM, BATCH, word, bits)
    return probes.groupBy(BUCKET, STREAM, BATCH, WORD).agg(F.bit_or(BITS).alias(BITS))


def add(rows: DataFrame, index: Index, batch: int, stream: str) -> None:
    """Note the ids of a batch; do so before its calls are stored.

    Then no stored call is unknown to the index, wherever a load stops; ids of a batch that
    stopped in between are stored when it is repeated, as every batch is.
    """
    owned = rows.select(
        "id",
        "created_at",
        _bucket(index),
        F.lit(stream).alias(STREAM),
        F.lit(batch).cast("bigint").alias(BATCH),
    )
    owned = materialize(owned)  # finding new rows is the dear part; both writes use them
    _store(_filter_of(index, owned), index.path(FILTER), WORD)
    _store(owned, index.path(IDS), "id")


def build(spark: SparkSession, calls_path: str, index: Index) -> None:
    """Index a call table that was loaded without one, into a fresh folder."""
    stored = call_table.read(spark, calls_path)
    owned = stored.select("id", "created_at", _bucket(index), STREAM, BATCH)
    _store(_filter_of(index, owned), index.path(FILTER), WORD, "errorifexists")
    _store(owned, index.path(IDS), "id", "errorifexists")


def suspects(
    rows: DataFrame, index: Index, batch: int | None = None, stream: str | None = None
) -> DataFrame | None:
    """(id, id_bucket) of the distinct ids the filter knows; None while nothing is indexed.

    What ``batch`` of ``stream`` added itself does not count. The filters of the touched
    buckets are read, about four bytes an id, and joined by word, so a frequent id in
    ``rows`` is one probe.
    """
    word, bits = _probe(index)
    probes = materialize(rows.select("id").distinct().select("id", _bucket(index), word, bits))
    known = _read(rows.sparkSession, index, FILTER, _buckets_of(probes))
    if known is None:
        return None
    words = known.where(~_own(batch, stream)).select(BUCKET, WORD, F.col(BITS).alias("_set"))
    hit = F.col("_set").bitwiseAND(F.col(BITS)) == F.col(BITS)
    return probes.join(words, [BUCKET, WORD]).where(hit).select("id", BUCKET).distinct()


def stored(
    rows: DataFrame, index: Index, batch: int | None = None, stream: str | None = None
) -> DataFrame | None:
    """The distinct ids of ``rows`` that other batches stored; None if there are none.

    Opens the buckets of ids the filter knows and no calls at all.
    """
    maybe = suspects(rows, index, batch, stream)
    if maybe is None:
        return None
    maybe = materialize(maybe)
    held = _read(rows.sparkSession, index, IDS, _buckets_of(maybe))
    if held is None:
        return None
    others = held.where(~_own(batch, stream)).select("id")
    return others.join(maybe.select("id"), "id").distinct()


def _own(batch: int | None, stream: str | None) -> Column:
    if batch is None:
        return F.lit(False)
    return (F.col(STREAM) == stream) & (F.col(BATCH) == batch)


def lookup(spark: SparkSession, calls_path: str, index: Index, call_id: str) -> DataFrame:
    """The stored row of one id: one bucket says which months hold it, and when.

    Under the default key an id may be stored once per instant; all its rows are returned.
    """
    wanted = spark.range(1).select(F.lit(call_id).alias("id")).select(_bucket(index))
    held = _read(spark, index, IDS, _buckets_of(wanted))
    if held is not None:
        places = held.where(F.col("id") == call_id).groupBy(month_of(F.col("created_at")).alias(MONTH))
        spans = places.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last")).collect()
        calls = call_table.read_months(spark, calls_path, [s[MONTH] for s in spans])
        if calls is not None:
            covered = [
                (F.col(MONTH) == s[MONTH]) & F.col("created_at").between(s["first"], s["last"])
                for s in spans
            ]
            return call_table.lookup(calls.where(reduce(Column.__or__, covered)), call_id)
    return spark.createDataFrame([], call_table.STORED_SCHEMA)


def compact(spark: SparkSession, index: Index, target: str) -> Index:
    """Copy the index into the fresh folder ``target`` with few files a bucket.

    As in ``calls.compact`` the newest batch of every stream stays apart, because it may be
    repeated. Words of settled batches become one.
    """
    copy = Index(target, index.buckets, index.words)
    held = _read(spark, index, IDS, None)
    if held is None:
        return copy
    owned = call_table.settled(held, "id", "created_at", BUCKET)
    _store(_filter_of(copy, owned), copy.path(FILTER), WORD, "errorifexists")
    _store(owned, copy.path(IDS), "id", "errorifexists")
    return copy
