"""Stored tables with a key: rows are put, replaced and removed without rewriting the table.

Rows lie in buckets by a hash of their *group* (a session's messages, say, share one). A change
writes the rows it puts, or *tombstones* for what it removes, into fresh folders of the
buckets it touches, and is committed as one version (``sources.snapshots``). A read opens the
buckets it needs, keeps the newest row of every key and leaves out what was removed later.
``compact`` merges what has piled up. Keys are never NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.sources import snapshots
from callgauge.sources.snapshots import Conflict, Snapshot

BUCKET, VERSION, GONE = "_bucket", "_version", "_gone"
ROW, GROUP = "row", "group"  # what a tombstone removes
TRIES = 10


@dataclass(frozen=True)
class Table:
    """Where a keyed table lies and how its rows are told apart.

    ``key`` is unique; rows of equal ``group`` share a bucket and can be removed together.
    The number of buckets is fixed for the life of a table.
    """

    root: str
    schema: T.StructType
    key: str = "id"
    group: str = "id"
    buckets: int = 64

    @property
    def stored(self) -> T.StructType:
        extra = [T.StructField(BUCKET, T.IntegerType()), T.StructField(GONE, T.StringType())]
        return T.StructType([*self.schema.fields, *extra])


def bucketed(table: Table, rows: DataFrame, gone: str | None = None) -> DataFrame:
    """Rows of the table as they are stored; ``gone`` makes them tombstones."""
    bucket = F.pmod(F.xxhash64(table.group), F.lit(table.buckets)).cast("int")
    missing = [f for f in table.schema if f.name not in rows.columns]
    return (
        rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        .select(*table.schema.names, bucket.alias(BUCKET), F.lit(gone).cast("string").alias(GONE))
    )


def _buckets_of(df: DataFrame) -> list[int]:
    """The distinct buckets of some rows; no more than the table has."""
    return sorted(r[BUCKET] for r in df.select(BUCKET).distinct().collect())


def _write(table: Table, rows: DataFrame) -> tuple[str, list[int]]:
    """(folder, buckets) of rows written by bucket; a large bucket may be several files."""
    spark = rows.sparkSession
    folder = snapshots.write(rows.hint("rebalance", BUCKET), table.root, BUCKET)
    written = spark.read.schema(table.stored).parquet(f"{table.root.rstrip('/')}/{folder}")
    return folder, _buckets_of(written)


def _entry(bucket: int, version: int, kind: str) -> str:
    return f"{bucket}/{version}/{kind}"


def _entries(snapshot: Snapshot) -> list[tuple[int, int, str, str]]:
    """(bucket, version, kind, folder) of everything a version consists of."""
    found = []
    for name, folder in snapshot.parts.items():
        bucket, version, kind = name.split("/")
        found.append((int(bucket), int(version), kind, folder))
    return found


def change(
    spark: SparkSession, table: Table, prepare: Callable[[Snapshot], DataFrame], kind: str = ROW
) -> Snapshot:
    """Commit the rows that ``prepare`` makes of the newest version.

    If another writer commits meanwhile they are made again, from its version.
    """
    for _ in range(TRIES):
        base = snapshots.current(spark, table.root)
        folder, buckets = _write(table, prepare(base))
        if not buckets:
            return base
        new = {_entry(b, base.version + 1, kind): folder for b in buckets}
        try:
            return snapshots.commit(spark, base, {**base.parts, **new}, base.notes)
        except Conflict:
            continue
    raise Conflict(f"{TRIES} other writers were faster")


def put(rows: DataFrame, table: Table) -> Snapshot:
    """Add rows, replacing those of the same key; of equal keys in ``rows`` any one stays."""
    ready = bucketed(table, rows, None)
    return change(rows.sparkSession, table, lambda _: ready)


def remove(keys: DataFrame, table: Table) -> Snapshot:
    """Remove the rows of some (group, key)."""
    wanted = keys.select(*dict.fromkeys((table.group, table.key))).distinct()
    return change(keys.sparkSession, table, lambda _: bucketed(table, wanted, ROW))


def remove_groups(groups: DataFrame, table: Table) -> Snapshot:
    """Remove all rows of some groups, at the cost of one row per group."""
    wanted = groups.select(table.group).distinct()
    return change(groups.sparkSession, table, lambda _: bucketed(table, wanted, GROUP), GROUP)


def read(
    spark: SparkSession,
    table: Table,
    groups: DataFrame | None = None,
    snapshot: Snapshot | None = None,
) -> DataFrame:
    """The rows of a version, of ``groups`` (one column, named like the group) if given.

    Buckets without a wanted group are not opened.
    """
    snapshot = snapshot or snapshots.current(spark, table.root)
    buckets = None
    if groups is not None:
        groups = groups.select(table.group).distinct()
        empty = groups.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema
                                    if f.name != table.group})
        buckets = _buckets_of(bucketed(table, empty, None))
    rows = _merged(spark, table, snapshot, buckets).select(*table.schema.names)
    return rows if groups is None else rows.join(groups, table.group, "left_semi").select(rows.columns)


def _opened(
    spark: SparkSession, table: Table, snapshot: Snapshot, kind: str, buckets: list[int] | None
) -> DataFrame | None:
    """What a version holds of one kind, with the version each row was written in."""
    folders: dict[int, list[str]] = {}
    for bucket, version, of, folder in _entries(snapshot):
        if of == kind and (buckets is None or bucket in buckets):
            path = f"{table.root.rstrip('/')}/{folder}/{snapshots.PART}={bucket}"
            folders.setdefault(version, []).append(path)
    found = [
        spark.read.schema(table.stored).parquet(*paths).withColumn(VERSION, F.lit(version))
        for version, paths in sorted(folders.items())
    ]
    return reduce(DataFrame.unionByName, found) if found else None


def _merged(
    spark: SparkSession, table: Table, snapshot: Snapshot, buckets: list[int] | None
) -> DataFrame:
    """The newest row of every key that nothing later removed, with its bucket."""
    rows = _opened(spark, table, snapshot, ROW, buckets)
    if rows is None:
        return spark.createDataFrame([], table.stored)
    dead = _opened(spark, table, snapshot, GROUP, buckets)
    if dead is not None:
        last = dead.groupBy(F.col(table.group).alias("_lost")).agg(F.max(VERSION).alias("_until"))
        rows = rows.join(last, F.col(table.group) == F.col("_lost"), "left").where(
            F.col("_until").isNull() | (F.col(VERSION) > F.col("_until"))
        )
    # copies of a key leave a map task as one row
    newest = F.max_by(F.struct(*table.stored.names), VERSION)
    return rows.groupBy(table.key).agg(newest.alias("_row")).select("_row.*").where(F.col(GONE).isNull())


def compact(spark: SparkSession, table: Table, least: int = 2) -> Snapshot:
    """Merge buckets of at least ``least`` folders or with group tombstones; others stay."""
    for _ in range(TRIES):
        base = snapshots.current(spark, table.root)
        entries = _entries(base)
        sizes: dict[int, int] = {}
        for bucket, _, kind, _ in entries:
            sizes[bucket] = sizes.get(bucket, 0) + (1 if kind == ROW else least)
        piled = [b for b, n in sizes.items() if n >= least]
        if not piled:
            return base
        merged = _merged(spark, table, base, piled).withColumn(GONE, F.lit(None).cast("string"))
        folder, buckets = _write(table, merged)
        parts = {_entry(b, v, k): f for b, v, k, f in entries if b not in piled}
        parts |= {_entry(b, base.version + 1, ROW): folder for b in buckets}
        try:
            return snapshots.commit(spark, base, parts, base.notes)
        except Conflict:
            continue
    raise Conflict(f"{TRIES} other writers were faster")
