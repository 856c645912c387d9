"""Keyed tables, the conversation store kept in them, and the kept session activity."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.operators import chat_store
from callgauge.plans import reports, tables
from callgauge.plans import sessions as session_shares
from callgauge.sources import keyed, snapshots

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("g", T.StringType()),
        T.StructField("v", T.StringType()),
    ]
)


@pytest.fixture
def table(tmp_path):
    return keyed.Table(str(tmp_path / "table"), SCHEMA, key="id", group="g", buckets=8)


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def held(spark, table, **options):
    return sorted(tuple(r) for r in keyed.read(spark, table, **options).collect())


def folders(spark, table):
    return dict(snapshots.current(spark, table.root).parts)


def test_put_replaces_and_writes_only_touched_buckets(spark, table):
    assert held(spark, table) == []
    keyed.put(rows(spark, *[(i, f"g{i % 9}", "old") for i in range(40)]), table)
    before = folders(spark, table)
    after = keyed.put(rows(spark, (3, "g3", "new"), (99, "g3", "added")), table)
    fresh = {k: f for k, f in after.parts.items() if k not in before}
    assert len(fresh) == 1 and all(after.parts[k] == f for k, f in before.items())
    want = {i: (i, f"g{i % 9}", "old") for i in range(40)} | {3: (3, "g3", "new"), 99: (99, "g3", "added")}
    assert held(spark, table) == sorted(want.values())
    # the same rows again change nothing
    keyed.put(rows(spark, (3, "g3", "new"), (99, "g3", "added")), table)
    assert held(spark, table) == sorted(want.values())


def test_removed_rows_and_groups_stay_gone_until_put_again(spark, table):
    keyed.put(rows(spark, *[(i, f"g{i % 3}", "v") for i in range(12)]), table)
    keyed.remove(rows(spark, (0, "g0", None), (77, "g0", None)), table)
    keyed.remove_groups(spark.createDataFrame([("g1",), ("nobody",)], "g string"), table)
    left = [(i, f"g{i % 3}", "v") for i in range(1, 12) if i % 3 != 1]
    assert held(spark, table) == left
    keyed.put(rows(spark, (1, "g1", "back")), table)
    assert held(spark, table) == sorted([*left, (1, "g1", "back")])
    keyed.compact(spark, table)
    assert held(spark, table) == sorted([*left, (1, "g1", "back")])
    assert all(k.endswith("/row") for k in folders(spark, table))
    keyed.remove_groups(spark.createDataFrame([("g0",), ("g1",), ("g2",)], "g string"), table)
    assert held(spark, table) == []
    keyed.compact(spark, table)
    assert folders(spark, table) == {}


def test_a_read_of_some_groups_opens_their_buckets(spark, table):
    keyed.put(rows(spark, *[(i, f"g{i}", "v") for i in range(30)]), table)
    wanted = spark.createDataFrame([("g4",)], "g string")
    found = keyed.read(spark, table, wanted)
    assert len({f.split("/_part=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert [tuple(r) for r in found.collect()] == [(4, "g4", "v")]


def test_a_writer_that_was_overtaken_starts_again(spark, table):
    keyed.put(rows(spark, (1, "g", "0")), table)
    seen = []

    def count_up(base):
        if not seen:  # another writer commits while this one prepares
            seen.append(base.version)
            keyed.put(rows(spark, (1, "g", "10")), table)
        value = F.col("v").cast("int") + 1
        return keyed.bucketed(table, keyed.read(spark, table, snapshot=base).withColumn("v", value.cast("string")))

    keyed.change(spark, table, count_up)
    assert held(spark, table) == [(1, "g", "11")]


def test_compaction_keeps_older_versions_readable(spark, table):
    keyed.put(rows(spark, (1, "g", "a")), table)
    old = keyed.put(rows(spark, (1, "g", "b"), (2, "h", "c")), table)
    keyed.compact(spark, table)
    assert held(spark, table) == held(spark, table, snapshot=old) == [(1, "g", "b"), (2, "h", "c")]
    assert keyed.compact(spark, table).version == 3  # nothing is left to merge


def test_messages_that_break_a_rule_are_refused(spark, tmp_path):
    kept = chat_store.store(str(tmp_path / "chat"), buckets=4)
    at = datetime(2026, 5, 1)
    keyed.put(
        spark.createDataFrame([("s", "u", None, at, at)], kept.sessions.schema), kept.sessions
    )
    later = at + timedelta(minutes=1)
    said = [
        ("m1", "s", "user", "hello there", later),
        ("m2", "s", "robot", "no", later),
        ("m3", "nowhere", "user", "no", later),
    ]
    for _ in range(2):
        refused = chat_store.append_messages(kept, spark.createDataFrame(said, kept.messages.schema))
        assert sorted(r.id for r in refused.collect()) == ["m2", "m3"]
    session = keyed.read(spark, kept.sessions).first()
    assert (session.title, session.updated_at) == ("hello there", later)
    assert [r.id for r in chat_store.transcript(spark, kept, "s").collect()] == ["m1"]


def test_kept_session_activity_equals_the_scan(spark, tmp_path):
    calls = tables.calls(spark, "/root/testdata/sf0.001")
    half = F.crc32(F.col("id").cast("binary")) % 2
    for batch in (0, 1, 1):
        session_shares.store_batch(calls.where(half == batch), str(tmp_path / "s"), batch, "s")
    got = session_shares.activity(spark, str(tmp_path / "s"), 7).collect()
    want = reports.session_activity(calls, 7).collect()
    assert [(r.session_id, r.n, r.started_at, r.last_at) for r in got] == [
        (r.session_id, r.n, r.started_at, r.last_at) for r in want
    ]
    assert [r.cost_usd for r in got] == pytest.approx([r.cost_usd for r in want])
    with pytest.raises(ValueError, match="limit"):
        session_shares.activity(spark, str(tmp_path / "s"), 0)


def test_frontiers_are_enough(spark, tmp_path, monkeypatch):
    """Sessions whose newest calls lie in different batches, with ties."""
    monkeypatch.setattr(session_shares, "MOST", 3)
    start = datetime(2026, 5, 1)
    calls = spark.createDataFrame(
        [(f"s{i * 7 % 10}", start + timedelta(minutes=i * 13 % 20), 0.5) for i in range(40)],
        "session_id string, created_at timestamp_ntz, total_cost double",
    )
    part = F.minute("created_at") % 4
    for batch in range(4):
        session_shares.store_batch(calls.where(part == batch), str(tmp_path / "s"), batch, "s")
    got = session_shares.activity(spark, str(tmp_path / "s"), 3)
    assert got.collect() == reports.session_activity(calls, 3).collect()
