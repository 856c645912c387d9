"""Conversation store: order, ties, empties, and the context window by brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from callgauge.operators import chat, context
from callgauge.plans import reports
from callgauge.schema import CALLS_SCHEMA, MESSAGES_SCHEMA, SESSIONS_SCHEMA, USERS_SCHEMA

T0 = datetime(2026, 5, 1)


def at(minutes: int) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def store(spark):
    sessions = [
        ("s1", "u1", None, at(0), at(9)),
        ("s2", "u1", "kept", at(1), at(5)),
        ("s3", "u1", None, at(2), at(5)),
        ("s4", "u2", None, at(3), at(3)),
    ]
    messages = [
        ("m1", "s1", "system", "be brief", at(0)),
        ("m2", "s1", "user", "x" * 200, at(1)),
        ("m4", "s1", "assistant", "newest", at(9)),
        ("m3", "s1", "assistant", "same instant, lower id", at(9)),
        ("m5", "s2", "user", "hello", at(4)),
        ("m6", "s2", "assistant", "", at(5)),
    ]
    return (
        spark.createDataFrame(sessions, SESSIONS_SCHEMA),
        spark.createDataFrame(messages, MESSAGES_SCHEMA),
    )


def test_session_list(store):
    rows = chat.session_list(*store, "u1").collect()
    assert [(r.id, r.message_count, r.preview) for r in rows] == [
        ("s1", 4, "newest"), ("s2", 2, None), ("s3", 0, None),
    ]
    assert [r.id for r in chat.session_list(*store, "u1", limit=1).collect()] == ["s1"]


def test_session_lists_hold_one_page_per_user(store):
    rows = chat.session_lists(*store, limit=2).collect()
    assert sorted((r.user_id, r.position, r.id) for r in rows) == [
        ("u1", 1, "s1"), ("u1", 2, "s2"), ("u2", 1, "s4"),
    ]


def test_session_detail(store):
    rows = chat.session_detail(*store).collect()
    seen = sorted((r.id, r.message_id, r.message_count, r.preview) for r in rows if r.message_id)
    assert [s[1] for s in seen] == ["m1", "m2", "m3", "m4", "m5", "m6"]
    assert {s[3] for s in seen if s[0] == "s2"} == {""}
    assert sorted(r.id for r in rows if r.message_id is None) == ["s3", "s4"]
    assert chat.session_detail(*store, "unknown").count() == 0
    assert [r.id for r in chat.transcript(store[1], "s1").collect()] == ["m1", "m2", "m3", "m4"]


def test_positions_run_over_days_and_refused_messages(spark):
    sessions = spark.createDataFrame([("s", "u", None, at(0), at(0))], SESSIONS_SCHEMA)
    day = [at(0) + timedelta(days=d) for d in (2, 0, 1, 0)]
    rows = [(f"m{i}", "s", "user", "x", t) for i, t in enumerate(day)]
    messages = spark.createDataFrame(rows, MESSAGES_SCHEMA)
    seen = {r.message_id: r.position for r in chat.session_detail(sessions, messages).collect()}
    assert seen == {"m1": 1, "m3": 2, "m2": 3, "m0": 4}
    odd = spark.createDataFrame([("a", "s", "robot", "x", at(0)), ("b", "?", "user", "x", at(0))], MESSAGES_SCHEMA)
    accepted, refused = chat.accepted_messages(messages.unionByName(odd), sessions)
    assert accepted.count() == 4
    assert {r.id: r.errors for r in refused.collect()} == {
        "a": ["role:choice"], "b": ["session_id:unknown"],
    }


def test_append_messages(store):
    rows = {r.id: r for r in chat.append_messages(*store).collect()}
    assert rows["s1"].title == "x" * 60 and rows["s2"].title == "kept"
    assert rows["s3"].title is None and rows["s3"].updated_at == at(5)
    assert rows["s1"].updated_at == at(9)


def test_users(spark):
    users = spark.createDataFrame(
        [("u1", "ann", at(0), at(0)), ("u2", "Ann", at(1), at(1))], USERS_SCHEMA
    )
    seen = spark.createDataFrame(
        [(" ann\n", at(7)), ("ann", at(5)), ("new", at(6)), ("new ", at(8))],
        "username string, seen_at timestamp_ntz",
    )
    merged = chat.upsert_users(users, seen)
    rows = {r.username: r for r in merged.collect()}
    assert set(rows) == {"ann", "Ann", "new"}
    assert (rows["ann"].id, rows["ann"].created_at, rows["ann"].last_seen_at) == ("u1", at(0), at(7))
    assert (rows["new"].created_at, rows["new"].last_seen_at) == (at(6), at(8))
    assert chat.find_user(merged, "ANN").first().id == "u1"
    assert {r.name: r.id for r in chat.users_by_name(merged).collect()}["ann"] == "u1"
    again = {r.username: r.id for r in chat.upsert_users(users, seen).collect()}
    assert again["new"] == rows["new"].id


def test_purge(spark, store):
    users = spark.createDataFrame([("u1", "a", T0, T0), ("u2", "b", T0, T0)], USERS_SCHEMA)
    doomed = spark.createDataFrame([("u1",), ("u1",)], "user_id string")
    left = chat.purge_users(users, *store, doomed)
    assert [[r.id for r in df.collect()] for df in left] == [["u2"], ["s4"], []]


def _window(turns, cap):
    system = [t for t in turns if t[1] == "system"][:1]
    rest = [t for t in turns if t[1] != "system"]
    return [t[0] for t in system + rest[-cap:]]


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_context_window_equals_brute_force(spark, cap):
    rng = random.Random(cap)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    conversations = {
        c: [(t, rng.choice(roles)) for t in range(rng.choice([0, 1, 5, 30, 400]))] for c in range(30)
    }
    rows = [(c, t, role, f"{c}-{t}", "m") for c, ts in conversations.items() for t, role in ts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, model string")
    got = {}
    for r in sorted(context.context_window(df, cap=cap).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append(r.turn)
    assert got == {c: _window(ts, cap) for c, ts in conversations.items() if ts}


def test_model_caps(spark):
    rows = [(m, t, "user", "x", m) for m in ("gpt-4o", "gemini-1.5-flash", "other") for t in range(100)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string, model string")
    counts = context.last_user_message(context.context_window(df))
    assert {r.conv_id: r.turns for r in counts.collect()} == {
        "gpt-4o": 30, "gemini-1.5-flash": 80, "other": 20,
    }


def test_kpis_with_errors_only(spark):
    row = ("c", None, "s", "openai", "m", "ERROR", 1.0, None, 1, 1, 0.5, None, None, None, at(0), "{}")
    calls = spark.createDataFrame([row], CALLS_SCHEMA)
    got = reports.kpis(calls, at(60)).first()
    assert (got.calls, got.errors, got.error_rate_pct, got.error_rate_all_pct) == (0, 1, 0.0, 100.0)
    assert (got.cost_usd, got.models_active) == (0.5, 0)
    empty = reports.kpis(calls, at(60 * 24 * 60)).first()
    assert (empty.calls, empty.errors, empty.cost_usd) == (0, 0, 0.0)
    assert reports.throughput(calls.replace("ERROR", "SUCCESS").replace(1.0, 0.0), at(60)).first()[
        "tokens_per_second"
    ] == 0.0


def test_custom_caps_leave_the_default_to_other_models(spark):
    turns = spark.createDataFrame(
        [(c, t, "user", "x", m) for c, m in ((1, "x"), (2, "other")) for t in range(30)],
        "conv_id long, turn long, role string, text string, model string",
    )
    caps = spark.createDataFrame([("x", 5)], "model string, cap int")
    shown = context.context_window(turns, caps=caps, max_cap=5).groupBy("conv_id").count()
    assert {r.conv_id: r["count"] for r in shown.collect()} == {1: 5, 2: 20}
    high = spark.createDataFrame([("x", 25)], "model string, cap int")
    with pytest.raises(Exception, match="exceeds max_cap"):
        context.context_window(turns, caps=high, max_cap=5).collect()


def test_blank_names_are_no_users(spark):
    users = spark.createDataFrame([], USERS_SCHEMA)
    stamp = datetime(2026, 5, 1)
    seen = spark.createDataFrame(
        [("  ", stamp), (None, stamp), ("", stamp), (" ann ", stamp)],
        "username string, seen_at timestamp_ntz",
    )
    assert [r.username for r in chat.upsert_users(users, seen).collect()] == ["ann"]
