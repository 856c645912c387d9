"""Z-order copies of the call table: same rows, and what filters skip."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from callgauge.sources import calls as call_table
from callgauge.sources import layout

START = datetime(2024, 1, 1)
N = 40_000


def row_groups(path, column, low, high):
    """(row groups whose statistics meet the range, all row groups)."""
    met = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for n in range(meta.num_row_groups):
            stats = meta.row_group(n).column(at).statistics
            total += 1
            met += stats.min <= high and stats.max >= low
    return met, total


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """A month of calls, copied in the plain order and in Z-order, small row groups each."""
    root = tmp_path_factory.mktemp("layout")
    n = F.col("id")
    draw = F.pmod(F.xxhash64("id"), F.lit(N))
    rows = spark.range(N).select(
        F.concat(F.lit("id-"), n.cast("string")).alias("id"),
        F.format_string("0000-%06d", F.pmod(F.xxhash64(n, F.lit(1)), F.lit(2000))).alias("session_id"),
        F.lit("p").alias("provider"),
        F.format_string("model-%d", F.pmod(F.xxhash64(n, F.lit(2)), F.lit(8))).alias("model"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=draw * 60)).alias("created_at"),
    )
    fields = [f for f in call_table.CALLS_SCHEMA if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})
    call_table.append(rows, f"{root}/calls", 0, "s")
    call_table.append(rows.limit(0), f"{root}/calls", 1, "s")
    small = {"parquet.block.size": "16384", "parquet.page.size.row.check.min": "100",
             "parquet.block.size.row.check.min": "100", "parquet.block.size.row.check.max": "200"}
    call_table.compact(spark, f"{root}/calls", f"{root}/plain", **small)
    call_table.compact(spark, f"{root}/calls", f"{root}/z", call_table.CLUSTER_BY, **small)
    return f"{root}/plain", f"{root}/z"


def test_same_rows(spark, copies):
    plain, z = (call_table.read(spark, path) for path in copies)
    assert plain.count() == z.count() == N
    assert plain.exceptAll(z).isEmpty()


@pytest.mark.parametrize(
    ("column", "low", "high", "share"),
    [
        ("created_at", START + timedelta(days=9), START + timedelta(days=10), 0.4),
        ("model", "model-3", "model-3", 0.4),
        ("session_id", "0000-001234", "0000-001234", 0.4),
    ],
)
def test_each_filter_skips_row_groups(copies, column, low, high, share):
    met, total = row_groups(copies[1], column, low, high)
    assert total > 60 and 0 < met < share * total


def test_the_plain_order_does_not_skip_by_session(copies):
    met, total = row_groups(copies[0], "session_id", "0000-001234", "0000-001234")
    assert met > 0.9 * total


def test_places(spark):
    values = [None, "a", "a", "a", "a", "a", "b", "c", "d"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n int")
    cuts = layout.bounds(df, ["v", "n"], bits=2)
    assert cuts["v"] == ["c"] and cuts["n"] == [2, 4, 6]
    at = layout.place("v", ["b", "d"], df.schema["v"].dataType)
    assert [r[0] for r in df.orderBy("n").select(at).collect()] == [0, 0, 0, 0, 0, 0, 1, 1, 2]
    assert layout.bounds(df.limit(0), ["v"]) == {"v": []}
    assert df.limit(0).select(layout.z_key(df.limit(0), ["v", "n"])).isEmpty()
    with pytest.raises(ValueError):
        layout.z_key(df, ["v", "n"], bits=32)


def test_key_takes_bits_in_turn(spark):
    df = spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    keys = df.select("x", "y", layout.z_key(df, ["x", "y"], bits=2).alias("z")).collect()
    want = {(x, y): (x & 1) | (y & 1) << 1 | (x & 2) << 1 | (y & 2) << 2 for x in range(4) for y in range(4)}
    assert {(r.x, r.y): r.z for r in keys} == want


def test_rows_of_a_stream_do_not_meet_in_one_task(spark, copies):
    """Whatever the size of the tables: which batch is a stream's newest is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = call_table.settled(call_table.read(spark, copies[0]), "id")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_of_one_place_are_dealt_to_several_tasks(spark, tmp_path):
    """Calls of one instant, model and session are one place in Z-order, but not one file."""
    rows = spark.range(2000).select(
        F.concat(F.lit("id-"), "id").alias("id"),
        F.lit("s").alias("session_id"),
        F.lit("m").alias("model"),
        F.lit(START).cast("timestamp_ntz").alias("created_at"),
    )
    fields = [f for f in call_table.CALLS_SCHEMA if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})
    call_table.append(rows, f"{tmp_path}/calls", 0, "s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        call_table.compact(spark, f"{tmp_path}/calls", f"{tmp_path}/z", call_table.CLUSTER_BY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "z").rglob("*.parquet")]
    assert sum(counts) == 2000 and max(counts) < 1500
