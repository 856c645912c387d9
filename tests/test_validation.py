"""Admission rules, field by field."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from callgauge.operators import loading, validation
from callgauge.schema import CALL_COLUMNS

GOOD = {
    "log_id": "00000000-0000-4000-8000-000000000001",
    "session_id": "00000000-0000-4000-8000-000000000002",
    "provider": "openai",
    "model": "gpt-4o-mini",
    "request_status": "SUCCESS",
    "latency_ms": 123.4,
    "ttft_ms": 78.9,
    "input_tokens": 10,
    "output_tokens": 20,
    "total_cost": 0.0005,
    "input_preview": "contact me at test@example.test",
    "timestamp": "2026-05-01T10:00:00Z",
    "metadata": {},
}
ABSENT = object()


def payload(**changes) -> str:
    record = {**GOOD, **changes}
    return json.dumps({k: v for k, v in record.items() if v is not ABSENT})


CASES = [
    (payload(), ""),
    (payload(latency_ms=ABSENT), "latency_ms:missing"),
    (payload(provider="made-up"), "provider:choice"),
    (payload(latency_ms=-5), "latency_ms:range"),
    (payload(latency_ms="5"), "latency_ms:type"),
    (payload(latency_ms=None), "latency_ms:type"),
    (payload(latency_ms=0), ""),
    (payload(total_cost=True), "total_cost:type"),
    (payload(ttft_ms=None), ""),
    (payload(ttft_ms=ABSENT), ""),
    (payload(ttft_ms=-1), "ttft_ms:range"),
    (payload(ttft_ms="soon"), "ttft_ms:type"),
    (payload(input_tokens=5.0), ""),
    (payload(input_tokens=5.5), "input_tokens:fraction"),
    (payload(output_tokens=3_000_000_000), "output_tokens:range"),
    (payload(model=""), "model:length"),
    (payload(model="m" * 100), ""),
    (payload(model="m" * 101), "model:length"),
    (payload(model=7), "model:type"),
    (payload(input_preview="é" * 500), ""),
    (payload(input_preview="é" * 501), "input_preview:length"),
    (payload(output_preview=7), "output_preview:type"),
    (payload(message_id=None), ""),
    (payload(message_id="nope"), "message_id:uuid"),
    (payload(log_id="not-a-uuid"), "log_id:uuid"),
    (payload(request_status="DONE"), "request_status:choice"),
    (payload(metadata=ABSENT), ""),
    (payload(metadata=None), "metadata:type"),
    (payload(metadata=[1]), "metadata:type"),
    (payload(timestamp="yesterday"), "timestamp:instant"),
    (payload(timestamp="2026-13-01T10:00:00Z"), "timestamp:instant"),
    (payload(timestamp=5), "timestamp:instant"),
    (payload(surprise=1), "record:unknown_key"),
    (payload(surprise=1, latency_ms=ABSENT), "record:unknown_key,latency_ms:missing"),
    ("not-json-at-all", "payload:malformed"),
    (payload() + " x", "payload:malformed"),
    (payload() + "," + payload(), "payload:malformed"),
    ("[" + payload() + "]", "payload:malformed"),
    ("null", "payload:malformed"),
    ("", "payload:malformed"),
    (None, "payload:malformed"),
]


def feed(spark, payloads):
    rows = [(f"{i:03d}", p, datetime(2026, 5, 1, 0, 0, i % 60)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "origin_id string, payload string, arrived_at timestamp_ntz")


@pytest.fixture(scope="module")
def checked(spark):
    rows = validation.check(feed(spark, [c[0] for c in CASES])).collect()
    return {int(r.origin_id): r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(checked, i):
    assert ",".join(checked[i].errors) == CASES[i][1]


def test_instants_become_utc(spark):
    stamps = {
        "2026-05-01T10:00:00+02:00": datetime(2026, 5, 1, 8),
        "2026-05-01T10:00:00.123456789Z": datetime(2026, 5, 1, 10, 0, 0, 123456),
        "2026-05-01t10:00:00z": datetime(2026, 5, 1, 10),
        "2026-05-01 10:00": datetime(2026, 5, 1, 10),
        "2026-05-01T10:00Z": datetime(2026, 5, 1, 10),
        "2026-05-01T10:00:00-0530": datetime(2026, 5, 1, 15, 30),
        "2026-05-01": datetime(2026, 5, 1),
    }
    rows = validation.check(feed(spark, [payload(timestamp=t) for t in stamps])).collect()
    rows.sort(key=lambda r: r.origin_id)
    assert [r.record.timestamp for r in rows] == list(stamps.values())


def test_metadata_keeps_types(spark):
    nested = {"k": 1, "s": "1", "n": None, "b": True, "o": {"a": [1, 2.5]}}
    row = validation.check(feed(spark, [payload(metadata=nested)])).first()
    assert json.loads(row.record.metadata) == nested


def test_split_keeps_the_original_payload(spark):
    good, dead = validation.split(validation.check(feed(spark, [c[0] for c in CASES])))
    assert good.count() + dead.count() == len(CASES)
    letters = {r.origin_id: r.payload for r in dead.collect()}
    assert all(letters[o] == CASES[int(o)][0] for o in letters)


def test_calls_are_projected_and_redacted(spark):
    row = loading.to_calls(validation.check(feed(spark, [payload()]))).first()
    stored = {c: row[c] for c in CALL_COLUMNS}
    assert stored["id"] == GOOD["log_id"] and stored["status"] == "SUCCESS"
    assert stored["created_at"] == datetime(2026, 5, 1, 10)
    assert stored["input_preview"] == "contact me at [EMAIL]"
    assert stored["output_preview"] is None and stored["metadata"] == "{}"


def test_duplicates_of_one_id(spark):
    """One id may own most rows; the earliest copy wins, the others are dead letters."""
    other = payload(log_id="00000000-0000-4000-8000-00000000000a")
    rows = loading.to_calls(validation.check(feed(spark, [payload()] * 40 + [other])))
    assert sorted(r.origin_id for r in loading.new_rows(rows).collect()) == ["000", "040"]
    dead = loading.duplicates(rows).collect()
    assert sorted(r.origin_id for r in dead) == [f"{i:03d}" for i in range(1, 40)]
    assert {tuple(r.errors) for r in dead} == {(loading.DUPLICATE,)}


def test_key_with_instant_lets_a_moved_copy_in(spark):
    moved = payload(timestamp="2026-05-02T10:00:00Z")
    rows = loading.to_calls(validation.check(feed(spark, [payload(), moved])))
    assert loading.new_rows(rows).count() == 2
    assert loading.new_rows(rows, key=("id",)).count() == 1
