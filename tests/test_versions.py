"""Versions of stored tables, refreshes by what changed, late rows, partial sums."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgauge.plans import incremental, rollup, tables
from callgauge.schema import CALLS_SCHEMA
from callgauge.sources import calls as call_table
from callgauge.sources import feed as feeds
from callgauge.sources import snapshots
from callgauge.streaming import late
from callgauge.streaming import load as live
from callgauge.streaming import rollup as live_rollup

SCHEMA = "x int, part string"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(spark, snapshot, wanted=None):
    schema = _table(spark, []).schema
    return sorted((r.x, r.part) for r in snapshots.read(spark, snapshot, schema, wanted).collect())


def test_of_two_writers_one_wins_and_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    empty = snapshots.current(spark, root)
    assert empty.version == 0 and _rows(spark, empty) == []
    first = snapshots.commit(
        spark, empty, dict.fromkeys("ab", snapshots.write(_table(spark, [(1, "a"), (2, "b")]), root, "part"))
    )
    # both prepare their change from version 1; a reader holds version 1
    reader = snapshots.current(spark, root)
    one = snapshots.write(_table(spark, [(10, "a")]), root, "part")
    other = snapshots.write(_table(spark, [(20, "b")]), root, "part")
    assert _rows(spark, snapshots.current(spark, root)) == [(1, "a"), (2, "b")]
    snapshots.commit(spark, first, {**first.parts, "a": one}, {"by": "one"})
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, first, {**first.parts, "b": other}, {"by": "other"})
    now = snapshots.current(spark, root)
    assert (now.version, now.notes, _rows(spark, now)) == (2, {"by": "one"}, [(2, "b"), (10, "a")])
    assert _rows(spark, reader) == [(1, "a"), (2, "b")]
    # the loser starts over from the new version
    snapshots.commit(spark, now, {**now.parts, "b": other})
    assert _rows(spark, snapshots.current(spark, root)) == [(10, "a"), (20, "b")]
    assert _rows(spark, snapshots.at(spark, root, 2)) == [(2, "b"), (10, "a")]
    opened = snapshots.read(spark, snapshots.current(spark, root), _table(spark, []).schema, {"a"})
    assert all(f"/{one}/" in f for f in opened.inputFiles())


def _call(i, at, latency=10.0):
    return (f"id-{i:04d}", "openai", "gpt-4o", "SUCCESS", latency, None, 1, 2, 0.5, at)


CALL = (
    "id string, provider string, model string, status string, latency_ms double, ttft_ms double, "
    "input_tokens int, output_tokens int, total_cost double, created_at timestamp_ntz"
)
NIGHT = datetime(2026, 5, 31)


def _calls(spark, rows):
    df = spark.createDataFrame(rows, CALL)
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in CALLS_SCHEMA if f.name not in df.columns}
    )


class Store:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)

    def load(self, batch, rows, stream="s"):
        call_table.append(_calls(self.spark, rows), f"{self.root}/calls", batch, stream)
        incremental.log(_calls(self.spark, rows), f"{self.root}/changes", batch, stream)

    def refresh(self, calls=None, days=30):
        calls = call_table.read(self.spark, f"{self.root}/calls") if calls is None else calls
        return incremental.refresh(calls, f"{self.root}/changes", f"{self.root}/rollup", NIGHT, days)

    def rows(self, snapshot):
        got = incremental.read(self.spark, snapshot).collect()
        return {(r.hour, r.n, r.p50_latency_ms, r.version) for r in got}


def test_refresh_by_change_follows_loads_repeats_and_removals(spark, tmp_path):
    store = Store(spark, tmp_path)
    day = datetime(2026, 5, 3)
    store.load(0, [_call(1, day), _call(2, day + timedelta(hours=1)), _call(3, day - timedelta(days=1))])
    assert store.rows(store.refresh()) == {
        (day, 1, 10.0, 1), (day + timedelta(hours=1), 1, 10.0, 1), (day - timedelta(days=1), 1, 10.0, 1),
    }
    # a late call, and a call of a new month; a repeated batch changes nothing
    for _ in range(2):
        store.load(1, [_call(4, day + timedelta(minutes=5), 30.0), _call(5, NIGHT + timedelta(days=1))])
    second = store.refresh()
    assert store.rows(second) == {
        (day, 2, 20.0, 2), (day + timedelta(hours=1), 1, 10.0, 1), (day - timedelta(days=1), 1, 10.0, 1),
        (NIGHT + timedelta(days=1), 1, 10.0, 2),
    }
    # without changes the version only notes the marks, and nothing is computed
    third = store.refresh()
    assert third.version == 3 and third.parts == second.parts and store.rows(third) == store.rows(second)
    # all calls of one day go: the day leaves the rollup
    stored = call_table.read(spark, f"{store.root}/calls")
    gone = F.col("created_at") < F.lit(day)
    incremental.log(stored.where(gone), f"{store.root}/changes", 0, "removals")
    fourth = store.refresh(stored.where(~gone))
    assert str((day - timedelta(days=1)).date()) not in fourth.parts
    assert {h for h, *_ in store.rows(fourth)} == {h for h, *_ in store.rows(second)} - {day - timedelta(days=1)}
    # calls before the window are no matter of a refresh
    store.load(2, [_call(6, day - timedelta(days=60))])
    assert store.rows(store.refresh(stored.where(~gone))) == store.rows(fourth)


def test_refreshes_that_overlap_leave_one_version(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path)
    store.load(0, [_call(1, datetime(2026, 5, 3))])
    first = store.refresh()
    store.load(1, [_call(2, datetime(2026, 5, 4))])
    compute, nested = incremental.by_hour, []

    def slow(calls):
        if not nested:  # a second refresh runs while the first computes
            nested.append(None)
            nested[0] = store.refresh()
        return compute(calls)

    monkeypatch.setattr(incremental, "by_hour", slow)
    with pytest.raises(snapshots.Conflict):
        store.refresh()
    now = snapshots.current(spark, f"{store.root}/rollup")
    assert now.version == first.version + 1 and now.parts == nested[0].parts
    assert len(store.rows(now)) == 2


def test_only_touched_months_and_days_are_read(spark, tmp_path):
    store = Store(spark, tmp_path)
    for i in range(4):
        store.load(i, [_call(i, datetime(2026, 2 + i, 3, 4))])
    calls = call_table.read(spark, f"{store.root}/calls")
    found = incremental.hours_only(calls, [datetime(2026, 4, 3, 4), datetime(2026, 4, 3, 6)])
    plan = found._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    assert "created_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_at" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert [r.id for r in found.collect()] == ["id-0002"]


def test_a_load_notes_its_hours(spark, tmp_path):
    feed = tables.feed(spark, "/root/testdata/sf0.001").limit(40)
    paths = [str(tmp_path / p) for p in ("calls", "dead", "changes")]
    live.load_batch(feed, 0, paths[0], paths[1], changes_path=paths[2])
    hours = {r.hour for r in spark.read.parquet(paths[2]).collect()}
    assert hours == {
        r.h for r in call_table.read(spark, paths[0]).select(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("h")).collect()
    }


def test_late_rows_are_kept_and_told_again_alike(spark, tmp_path):
    source, split, timely, offsets = (str(tmp_path / p) for p in ("feed", "split", "timely", "offsets"))
    start = datetime(2026, 5, 1, 12)

    def rows(*minutes):
        return spark.createDataFrame(
            [(f"{m}", None if m is None else start + timedelta(minutes=m)) for m in minutes],
            "id string, created_at timestamp_ntz",
        )

    failures = []

    def keep(batch, number, stream):
        call_table.replace_batch(batch, timely, number, stream)
        if number == 1 and not failures:  # the driver is lost after the handler wrote
            failures.append(number)
            raise RuntimeError("lost")

    def drain():
        feed = feeds.stream_files(spark, source, schema=rows().schema)
        late.split_stream(feed, "created_at", "30 MINUTES", split, offsets, keep).awaitTermination()

    rows(0, 100, None).write.mode("append").parquet(source)
    drain()
    rows(60, 70, 200).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        drain()
    drain()  # the failed batch again, its mark is still that of the first
    rows(169, 170, None).write.mode("append").parquet(source)
    drain()
    assert sorted(r.id for r in spark.read.parquet(timely).collect()) == ["0", "100", "170", "200", "70", "None", "None"]
    missed = late.late(spark, split, rows().schema).collect()
    assert sorted((r.id, r.late_by_us) for r in missed) == [("169", 60_000_000), ("60", 600_000_000)]


def test_fresh_rollup_shows_open_hours_and_repeats_nothing(spark, tmp_path):
    path, target = str(tmp_path / "partials"), str(tmp_path / "folded")
    day = datetime(2026, 5, 3)
    for batch, rows in enumerate(([_call(1, day)], [_call(2, day, 30.0)], [_call(3, day - timedelta(days=400))])):
        for _ in range(2):
            live_rollup.store_partials(_calls(spark, rows), path, batch, "s")
    got = live_rollup.fresh(spark, path)
    assert {(r.hour, r.n, r.total_latency_ms) for r in got.collect()} == {
        (day, 2, 40.0), (day - timedelta(days=400), 1, 10.0),
    }
    live_rollup.fold(spark, path, target)
    assert {(r.load_stream, r.load_batch) for r in spark.read.parquet(target).collect()} == {
        ("compacted", 0), ("s", 2),
    }
    again = live_rollup.fresh(spark, target)
    assert sorted((r.hour, r.n) for r in again.collect()) == sorted((r.hour, r.n) for r in got.collect())
    daily = rollup.reaggregate(again).where(F.col("day") == F.lit(day)).first()
    assert (daily.n, daily.p50_latency_ms) == (2, 10.0)


def test_readers_see_all_of_a_batch_or_nothing(spark, tmp_path, monkeypatch):
    """A load that stops between its tables shows neither; once repeated, both."""
    calls, dead, noted = (str(tmp_path / p) for p in ("calls", "dead", "commits"))
    feed = tables.feed(spark, "/root/testdata/sf0.001").limit(60)
    paths = {"stream": "s", "commits_path": noted}

    def seen(path):
        done = call_table.commits(spark, noted)
        return call_table.visible(spark.read.parquet(path), done).count()

    live.load_batch(feed.limit(20), 0, calls, dead, **paths)
    before = seen(calls), seen(dead)
    write = live.write_dead

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(live, "write_dead", lost)
    with pytest.raises(RuntimeError, match="lost"):
        live.load_batch(feed, 1, calls, dead, **paths)
    assert (seen(calls), seen(dead)) == before
    assert call_table.read(spark, calls).count() > before[0]
    monkeypatch.setattr(live, "write_dead", write)
    for _ in range(2):
        live.load_batch(feed, 1, calls, dead, **paths)
    assert seen(calls) == call_table.read(spark, calls).count()
    assert seen(calls) + seen(dead) == 20 + 60
