"""Streams against their batch twins, and restarts."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from callgauge.functions.plugins import guarded_span_finder, span_finder
from callgauge.operators import loading, validation
from callgauge.plans import reports, rollup, tables
from callgauge.schema import CHUNKS_SCHEMA, FEED_SCHEMA
from callgauge.sources import calls as call_table
from callgauge.sources import feed as feeds
from callgauge.streaming import assembly as live_assembly
from callgauge.streaming import closing
from callgauge.streaming import load as live

from test_validation import payload


def _write(spark, path, rows):
    df = spark.createDataFrame(rows, FEED_SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)


def _id(i: int) -> str:
    return f"00000000-0000-4000-8000-{i:012d}"


def _row(i: int, log: int | None, stamp="2026-05-01T10:00:00Z"):
    body = "broken" if log is None else payload(log_id=_id(log), timestamp=stamp)
    return (f"{i:04d}", body, datetime(2026, 5, 1, 11, 0, i % 60))


def test_load_stream_restarts_where_it_stopped(spark, tmp_path):
    source, stored, dead, offsets = (str(tmp_path / p) for p in ("feed", "calls", "dead", "offsets"))

    def drain():
        feed = feeds.stream_files(spark, source, max_files=1)
        live.load_stream(feed, stored, dead, offsets).awaitTermination()

    _write(spark, source, [_row(0, 1), _row(1, 2), _row(2, None), _row(3, 1)])
    drain()
    # the second file repeats a stored call, adds one of another month and one new
    _write(spark, source, [_row(4, 2), _row(5, 3, "2026-06-02T00:00:00Z"), _row(6, 4)])
    drain()
    calls = call_table.read(spark, stored)
    assert sorted(r.id for r in calls.collect()) == [_id(i) for i in (1, 2, 3, 4)]
    assert {str(r.created_month) for r in calls.collect()} == {"2026-05-01", "2026-06-01"}
    letters = {r.origin_id: r.errors for r in spark.read.parquet(dead).collect()}
    assert letters == {
        "0002": ["payload:malformed"], "0003": ["id:duplicate"], "0004": ["id:duplicate"],
    }


def test_repeated_batch_changes_nothing(spark, tmp_path):
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    first = spark.createDataFrame([_row(0, 1), _row(1, None)], FEED_SCHEMA)
    second = spark.createDataFrame([_row(2, 1), _row(3, 2)], FEED_SCHEMA)
    for batch, rows in ((0, first), (1, second), (1, second)):
        live.load_batch(rows, batch, stored, dead)
    assert sorted(r.id for r in call_table.read(spark, stored).collect()) == [_id(1), _id(2)]
    letters = spark.read.parquet(dead).collect()
    assert sorted(r.origin_id for r in letters) == ["0001", "0002"]


def test_out_of_range_months_and_retries(spark, tmp_path):
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    rows = spark.createDataFrame([_row(0, 1), _row(1, 2, "2031-01-01T00:00:00Z")], FEED_SCHEMA)
    live.load_batch(rows, 0, stored, dead, first_month="2026-04-01", months=14)
    letters = spark.read.parquet(dead)
    assert [r.errors for r in letters.collect()] == [[loading.NO_PARTITION]]
    # two more attempts are allowed, then the row is left alone
    for batch in (1, 2):
        again = loading.retryable(spark.read.parquet(dead).where(f"load_batch = {batch - 1}"))
        assert again.count() == 1
        live.load_batch(again, batch, stored, dead, first_month="2026-04-01", months=14)
    last = spark.read.parquet(dead).where("load_batch = 2")
    assert last.first().attempts == 3 and loading.retryable(last).count() == 0


def test_replay_loads_a_corrected_letter(spark, tmp_path):
    dead = validation.dead(validation.check(spark.createDataFrame([_row(0, None)], FEED_SCHEMA)))
    assert validation.good(loading.replay(dead)).count() == 0
    mended = dead.replace("broken", payload(log_id=_id(9)), "payload")
    assert validation.good(loading.replay(mended)).count() == 1


def test_time_bound_prunes_months(spark, tmp_path):
    path = str(tmp_path / "calls")
    calls = tables.calls(spark, "/root/testdata/sf0.001")
    call_table.append(calls, path, 0, "test")
    stored = call_table.read(spark, path)
    report = reports.status_by_hour(stored, tables.AS_OF, 24)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan.replace("\n", " ")
    assert "PushedFilters: [IsNotNull(created_at)" in plan.replace("\n", " ")
    assert report.collect() == reports.status_by_hour(calls, tables.AS_OF, 24).collect()
    assert call_table.lookup(stored, calls.first().id).count() == 1


def test_refresh_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "rollup")
    calls = tables.calls(spark, "/root/testdata/sf0.001")
    rollup.refresh(calls, path, tables.AS_OF, 30)
    before = rollup.read(spark, path).count()
    # a later refresh of three days sees none of the calls: only those days change
    rollup.refresh(calls.where("status = 'SUCCESS'"), path, tables.AS_OF, 3)
    after = rollup.read(spark, path)
    old = after.where("day < date'2024-01-28'")
    assert old.count() == rollup.hourly(
        calls.where("created_at < timestamp_ntz'2024-01-28'"), tables.AS_OF, 30
    ).count()
    assert after.where("day >= date'2024-01-28' and status <> 'SUCCESS'").count() == 0
    assert after.count() < before


@pytest.mark.parametrize("bad", [0, 721])
def test_report_bounds(spark, bad):
    calls = tables.calls(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="hours"):
        reports.latency(calls, tables.AS_OF, bad)


def test_topic_records_become_feed_rows(spark):
    """The columns a topic delivers; the connector itself is not part of the image."""
    record = ("calls", bytearray(b"payload"), 3, 42, datetime(2026, 5, 1, 10))
    df = spark.createDataFrame(
        [record], "topic string, value binary, partition int, offset bigint, timestamp timestamp"
    )
    row = feeds.from_topic(df).first()
    assert (row.origin_id, row.payload) == ("calls-3-42", "payload")
    assert feeds.from_topic(df).schema["arrived_at"].dataType == FEED_SCHEMA["arrived_at"].dataType


def test_unreadable_table_is_an_error_not_an_empty_one(spark, tmp_path):
    """Only a table that does not exist yet counts as empty."""
    feed = spark.createDataFrame([_row(0, 1)], FEED_SCHEMA)
    with pytest.raises(Exception, match="scheme"):
        live.load_batch(feed, 0, "nosuchfs://host/calls", str(tmp_path / "dead"))


def test_preview_stream_with_bounded_state(spark, tmp_path):
    """Two micro-batches: order does not matter, calls end by their event or by the gap."""
    source, out, offsets = (str(tmp_path / p) for p in ("chunks", "out", "offsets"))
    start = datetime(2026, 5, 1, 10)

    def event(call, seq, kind, second, **fields):
        body = json.dumps({"type": kind, **fields})
        return (call, seq, start + timedelta(seconds=second), body)

    def words(call, seq, text, second):
        delta = {"type": "text_delta", "text": text}
        return event(call, seq, "content_block_delta", second, delta=delta)

    def add(rows):
        df = spark.createDataFrame(rows, CHUNKS_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(source)

    def drain():
        chunks = feeds.stream_files(spark, source, schema=CHUNKS_SCHEMA)
        live_assembly.write(
            live_assembly.preview_stream(chunks, "messages", gap_seconds=60, max_chars=6), out, offsets
        ).awaitTermination()
        return {r.call_id: r for r in spark.read.parquet(out).collect()}

    usage = {"usage": {"output_tokens": 9}, "delta": {"stop_reason": "end_turn"}}
    add([
        words("a", 3, "ghijkl", 3), words("a", 1, "abc", 1),
        words("open", 1, "never ", 1), words("open", 2, "ended", 2),
        event("b", 0, "message_start", 0, message={"usage": {"input_tokens": 4}}),
        words("b", 1, "done", 1), event("b", 2, "message_stop", 2),
    ])
    first = drain()
    assert set(first) == {"b"} and first["b"].complete
    assert (first["b"].text, first["b"].input_tokens, first["b"].output_tokens) == ("done", 4, None)
    add([
        words("a", 2, "def", 2), event("a", 4, "message_delta", 4, **usage),
        event("a", 5, "message_stop", 5), words("later", 1, "x", 3600),
    ])
    got = drain()
    assert set(got) == {"a", "b", "open"}
    a = got["a"]
    assert (a.text, a.n_chars, a.n_chunks, a.output_tokens, a.stop_reason) == (
        "abcdef", 12, 5, 9, "end_turn",
    )
    assert (a.first_text_at, a.last_at) == (start + timedelta(seconds=1), start + timedelta(seconds=5))
    assert (got["open"].text, got["open"].complete, got["open"].n_chars) == ("never ", False, 11)


def test_two_feeds_and_a_replay_share_the_tables(spark, tmp_path):
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    for name, rows in (("a", [_row(0, 1), _row(1, 2), _row(2, None)]), ("b", [_row(3, 2), _row(4, 3)])):
        source = str(tmp_path / name)
        _write(spark, source, rows)
        feed = feeds.stream_files(spark, source, max_files=1)
        live.load_stream(feed, stored, dead, str(tmp_path / f"offsets-{name}")).awaitTermination()
    assert sorted(r.id for r in call_table.read(spark, stored).collect()) == [
        _id(i) for i in (1, 2, 3)
    ]
    letters = spark.read.parquet(dead)
    assert {r.origin_id: r.attempts for r in letters.collect()} == {"0002": 1, "0003": 1}
    again = loading.retryable(letters)
    live.load_batch(again, 0, stored, str(tmp_path / "dead2"), stream="replay")
    assert call_table.read(spark, stored).count() == 3
    assert {r.attempts for r in spark.read.parquet(str(tmp_path / "dead2")).collect()} == {2}


def test_only_the_touched_months_are_opened(spark, tmp_path):
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    for batch, month in enumerate(("03", "04", "05", "06")):
        rows = spark.createDataFrame([_row(batch, batch, f"2026-{month}-02T00:00:00Z")], FEED_SCHEMA)
        live.load_batch(rows, batch, stored, dead, stream="s")
    opened = call_table.read_months(spark, stored, [date(2026, 5, 1), date(2027, 1, 1)])
    assert len(opened.inputFiles()) == 1
    assert call_table.read_months(spark, stored, [date(2027, 1, 1)]) is None


def test_compaction_keeps_rows_and_the_newest_batch(spark, tmp_path):
    stored, target, dead = (str(tmp_path / p) for p in ("calls", "compacted", "dead"))
    for batch in range(4):
        rows = spark.createDataFrame([_row(batch, batch)], FEED_SCHEMA)
        live.load_batch(rows, batch, stored, dead, stream="s")
    call_table.compact(spark, stored, target)
    copied = call_table.read(spark, target)
    assert len(copied.inputFiles()) == 2 < len(call_table.read(spark, stored).inputFiles())
    # the stream may repeat its newest batch, and nothing is lost or doubled
    live.load_batch(rows, 3, target, dead, stream="s")
    after = {(r.id, r.load_stream, r.load_batch) for r in call_table.read(spark, target).collect()}
    assert after == {(_id(i), "compacted", 0) for i in range(3)} | {(_id(3), "s", 3)}


def test_entities_are_replaced_after_the_rules(spark, tmp_path):
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    find = span_finder(lambda: lambda t: [(0, 7, "PERSON")] if t.startswith("contact") else [])
    feed = spark.createDataFrame([_row(0, 1)], FEED_SCHEMA)
    live.load_batch(feed, 0, stored, dead, entities=find)
    row = call_table.read(spark, stored).first()
    assert row.input_preview == "[PERSON] me at [EMAIL]" and row.output_preview is None


def test_replay_remembers_attempts(spark):
    feed = spark.createDataFrame([_row(0, None)], FEED_SCHEMA)
    checked = validation.check(feed.withColumn("attempts", F.lit(2)))
    assert loading.replay(validation.dead(checked)).first().attempts == 2


def test_lag_of_a_running_stream():
    def report(*sources):
        return SimpleNamespace(json=json.dumps({"sources": sources}))

    topic = {"latestOffset": {"calls": {"0": 9, "1": 4}}, "endOffset": {"calls": {"0": 7, "1": 4}}}
    fresh = {"latestOffset": {"more": {"0": 3}}, "endOffset": None}
    assert feeds.lag(report(topic)) == 2 and feeds.lag(report(topic, fresh)) == 5
    assert feeds.lag(report(topic, {"latestOffset": None, "endOffset": {"logOffset": 0}})) is None


def test_a_mark_closes_the_last_calls(spark, tmp_path):
    """Two runs without a mark leave the newest call open; the mark brings it out, once."""
    source, out, marks, offsets = (str(tmp_path / p) for p in ("chunks", "out", "marks", "offsets"))
    body = json.dumps({"choices": [{"delta": {"content": "hi"}}]})

    def drain():
        chunks = feeds.stream_files(spark, source, schema=CHUNKS_SCHEMA)
        rows = live_assembly.assemble_stream(closing.with_marks(chunks, marks))
        live_assembly.write(rows, out, offsets).awaitTermination()
        return sorted(r.call_id for r in spark.read.parquet(out).collect())

    for i, call in enumerate("ab"):
        row = (call, 0, datetime(2026, 5, 1, 10 + i), body)
        spark.createDataFrame([row], CHUNKS_SCHEMA).write.mode("append").parquet(source)
        left = drain()
    assert left == ["a"]
    closing.mark(spark, CHUNKS_SCHEMA, marks, "ts")
    assert drain() == ["a", "b"] and drain() == ["a", "b"]


def _failing_on(*words):
    def load():
        def analyze(text):
            if any(w in text for w in words):
                raise ValueError(text)
            return []

        return analyze

    return load


def _said(i: int, log: int, text: str):
    return (f"{i:04d}", payload(log_id=_id(log), input_preview=text), datetime(2026, 5, 1, 11, 0, i))


def test_a_failing_row_does_not_hold_up_a_stream_nor_its_restart(spark, tmp_path):
    source, stored, dead, offsets = (str(tmp_path / p) for p in ("feed", "calls", "dead", "offsets"))

    def drain(entities):
        feed = feeds.stream_files(spark, source, max_files=1)
        live.load_stream(feed, stored, dead, offsets, entities=entities).awaitTermination()

    _write(spark, source, [_said(i, i, "bad" if i == 3 else "fine") for i in range(8)])
    drain(span_finder(_failing_on("bad")))
    assert sorted(r.id for r in call_table.read(spark, stored).collect()) == [
        _id(i) for i in range(8) if i != 3
    ]
    letters = spark.read.parquet(dead)
    assert [(r.origin_id, r.errors, r.attempts) for r in letters.collect()] == [("0003", ["row:failed"], 3)]
    assert loading.retryable(letters).count() == 0
    _write(spark, source, [_said(9, 9, "worse"), _said(10, 10, "fine")])
    drain(guarded_span_finder(_failing_on("worse")))
    assert call_table.read(spark, stored).count() == 8
    assert {r.origin_id: (r.errors, r.attempts) for r in spark.read.parquet(dead).collect()} == {
        "0003": (["row:failed"], 3),
        "0009": (["input_preview:ValueError"], 3),
    }


def test_a_batch_that_fails_as_a_whole_fails(spark, tmp_path):
    rows = [_said(i, i, "bad") for i in range(6)]
    feed = spark.createDataFrame(rows, FEED_SCHEMA)
    for isolate in (0, 3):
        with pytest.raises(Exception, match="ValueError"):
            live.load_batch(
                feed, 0, str(tmp_path / "calls"), str(tmp_path / "dead"),
                entities=span_finder(_failing_on("bad")), isolate=isolate,
            )
    assert not (tmp_path / "calls").exists()


def test_halving_reads_less_each_time(spark):
    """Two bad rows of 400 are found without the whole batch being tried time and again."""
    feed = spark.range(400).select(F.format_string("%04d", "id").alias("origin_id"))
    asked = []

    def attempt(part):
        ids = {r.origin_id for r in part.select("origin_id").collect()}
        asked.append(len(ids))
        if ids & {"0007", "0208"}:
            raise PySparkException("bad row")

    assert sorted(live.failing(feed, attempt)) == ["0007", "0208"]
    assert max(asked) < 100 and sum(asked) < 2 * 400


def test_only_the_step_that_fails_is_tried_again(spark, tmp_path, monkeypatch):
    """Payloads are checked for the load, for the whole batch, and not for each part of it."""
    checks = []
    check = validation.check
    monkeypatch.setattr(live.validation, "check", lambda feed: checks.append(1) or check(feed))
    rows = [_said(i, i, "bad" if i == 5 else "fine") for i in range(12)]
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    live.load_batch(
        spark.createDataFrame(rows, FEED_SCHEMA), 0, stored, dead,
        entities=span_finder(_failing_on("bad")),
    )
    assert len(checks) == 1
    assert call_table.read(spark, stored).count() == 11
    assert [r.origin_id for r in spark.read.parquet(dead).collect()] == ["0005"]


def test_the_feed_of_one_file_is_dealt_to_several_tasks(spark, sf_dir):
    """Reading it is little work, checking it is not; the letters are few files all the same."""
    feed = tables.feed(spark, sf_dir)
    assert feed.select(F.spark_partition_id()).distinct().count() > 4
    streamed = tables.feed_of(tables.table_stream(spark, sf_dir, "events"))
    assert "RepartitionByExpression" in streamed._jdf.queryExecution().analyzed().toString()


def test_letters_of_many_tasks_are_few_files(spark, tmp_path):
    letters = validation.dead(validation.check(spark.createDataFrame(
        [_row(i, None) for i in range(40)], FEED_SCHEMA
    ).repartition(20).withColumn("attempts", F.lit(0))))
    live.write_dead(letters, str(tmp_path / "dead"), 0, "s")
    assert len(list((tmp_path / "dead").rglob("*.parquet"))) <= 4
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 40


def test_parts_of_the_events_give_parts_of_the_feed(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    third = F.left("origin_id", F.lit(12)).cast("bigint") % 3
    part = tables.feed_of(events.where(F.col("event_id") % 3 == 1))
    whole = tables.feed(spark, sf_dir).where(third == 1)
    assert part.count() == whole.count() > 0 and part.exceptAll(whole).isEmpty()


def test_transient_failures_are_no_letters(spark, tmp_path):
    """A row that fails once and then succeeds is loaded, by either way."""
    seen = tmp_path / "seen"

    def load():
        def analyze(text):
            if "bad" in text and not seen.exists():
                seen.touch()
                raise ValueError(text)
            return []

        return analyze

    feed = spark.createDataFrame([_said(0, 0, "bad"), _said(1, 1, "fine")], FEED_SCHEMA)
    live.load_batch(feed, 0, str(tmp_path / "a"), str(tmp_path / "dead"), entities=guarded_span_finder(load))
    assert call_table.read(spark, str(tmp_path / "a")).count() == 2
    seen.unlink()
    live.load_batch(feed, 0, str(tmp_path / "b"), str(tmp_path / "dead"), entities=span_finder(load))
    assert call_table.read(spark, str(tmp_path / "b")).count() == 2


def test_guarded_spans_are_the_plain_ones(spark):
    def load():
        return lambda t: [(0, 3, "PERSON"), (0, 1, "OTHER")] if t == "Ada" else []

    df = spark.createDataFrame([("Ada",), (None,), ("x",)], "t string")
    both = df.select(span_finder(load)("t").alias("a"), guarded_span_finder(load)("t").alias("b"))
    assert all(r.a == r.b.spans and r.b.error is None for r in both.collect())


def test_one_large_partition_goes_on_in_pieces(spark, tmp_path, monkeypatch):
    """What a task holds of checked rows does not grow with the partition they were checked in."""
    tasks, pieces = [], "spark.sql.files.maxPartitionBytes"
    new_rows = loading.new_rows

    def asked(rows, *rest):
        tasks.append(rows.select(F.spark_partition_id()).distinct().count())
        return new_rows(rows, *rest)

    monkeypatch.setattr(live.loading, "new_rows", asked)
    monkeypatch.setattr(live, "STAGED_BLOCK", 32 << 10, raising=False)
    before = spark.conf.get(pieces)
    spark.conf.set(pieces, "32k")
    try:
        rows = [_said(i % 60, i, f"said {i}") for i in range(2000)]
        feed = spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1)
        live.load_batch(feed, 0, str(tmp_path / "calls"), str(tmp_path / "dead"))
    finally:
        spark.conf.set(pieces, before)
    assert tasks[0] > 2
    assert call_table.read(spark, str(tmp_path / "calls")).select("id").distinct().count() == 2000


def test_checked_rows_are_put_away_after_their_batch(spark, tmp_path, monkeypatch):
    """They are read from files while it runs, and gone whether it ends or fails."""
    places, seen = [], []
    scratch, new_rows = live.scratch_path, loading.new_rows
    monkeypatch.setattr(live, "scratch_path", lambda *a: places.append(scratch(*a)) or places[-1])
    monkeypatch.setattr(
        live.loading, "new_rows", lambda rows, *a: seen.append(rows.inputFiles()) or new_rows(rows, *a)
    )
    feed = spark.createDataFrame([_row(0, 1), _row(1, None), _row(2, 1)], FEED_SCHEMA)
    stored, dead = str(tmp_path / "calls"), str(tmp_path / "dead")
    live.load_batch(feed, 0, stored, dead)
    assert seen[0] and all(places[0].removeprefix("file:") in name for name in seen[0])
    with pytest.raises(Exception, match="scheme"):
        live.load_batch(feed, 1, "nosuchfs://host/calls", dead)
    assert len(places) == 2 and not any(Path(p.removeprefix("file://")).exists() for p in places)
    assert call_table.read(spark, stored).count() == 1
    assert sorted(r.errors[0] for r in spark.read.parquet(dead).collect()) == [
        "id:duplicate", "payload:malformed",
    ]
