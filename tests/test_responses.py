"""Response extraction, chunk assembly, pricing and record building."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgauge.functions.outcome import classify
from callgauge.functions.plugins import token_counter
from callgauge.operators import assembly, pricing, records, responses
from callgauge.operators.assembly import BLOCK
from callgauge.sources import catalogs

START = datetime(2026, 5, 1, 10)
CHUNKS = "call_id string, seq bigint, ts timestamp_ntz, chunk string"


def completion(text=None, usage=None) -> str:
    body = {"choices": [] if text is None else [{"delta": {"content": text}}]}
    if usage:
        body["usage"] = {"prompt_tokens": usage[0], "completion_tokens": usage[1]}
    return json.dumps(body)


def stream(call, documents):
    return [
        (call, i, START + timedelta(milliseconds=10 * (i + 1)), d) for i, d in enumerate(documents)
    ]


def assembled(spark, rows, shape="completion", **options):
    df = assembly.assemble(spark.createDataFrame(rows, CHUNKS), shape, **options)
    return {r.call_id: r for r in df.collect()}


def test_prices(spark):
    cases = [
        ("openai", "gpt-4o-mini", 1000, 500, 0.00045, False),
        ("openai", "gpt-9-future", 100, 200, 0.0, True),
        ("anthropic", "claude-3-5-sonnet-latest", 0, 0, 0.0, False),
        ("openrouter", "openai/gpt-4o-mini", 1000, 500, 0.00045, False),
        ("openrouter", "anthropic/claude-3.5-sonnet", 1000, 500, 0.0105, False),
        ("openrouter", "nonexistent/imaginary-model-9000", 1000, 500, 0.0, True),
    ]
    df = spark.createDataFrame(
        [c[:4] for c in cases], "provider string, model string, input_tokens int, output_tokens int"
    )
    got = {(r.provider, r.model): r for r in pricing.with_cost(df).collect()}
    for provider, model, _, _, cost, missing in cases:
        row = got[provider, model]
        assert row.total_cost == pytest.approx(cost, abs=1e-12) and row.cost_missing is missing
    assert catalogs.prices(spark).count() == 24


def test_completion_stream(spark):
    rows = stream("a", [completion(""), completion("Hello "), completion("world"), completion("!"),
                        completion(usage=(12, 3))])
    row = assembled(spark, rows)["a"]
    assert (row.text, row.input_tokens, row.output_tokens) == ("Hello world!", 12, 3)
    assert row.first_text_at == START + timedelta(milliseconds=20)


def test_last_usage_wins_and_missing_usage_is_estimated(spark):
    rows = stream("a", [completion("x", (1, 1)), completion("y", (9, 7))])
    rows += stream("b", [completion("Hi"), completion(" there")])
    got = assembled(spark, rows)
    assert (got["a"].input_tokens, got["a"].output_tokens) == (9, 7)
    df = assembly.assemble(spark.createDataFrame(rows, CHUNKS))
    filled = {r.call_id: r for r in assembly.backfill_usage(df).collect()}
    assert (filled["b"].output_tokens, filled["b"].cost_estimated) == (2, True)
    assert (filled["a"].output_tokens, filled["a"].cost_estimated) == (7, False)
    none = assembly.backfill_usage(df, estimator=lambda _: F.lit(None).cast("int"))
    assert {r.call_id: r.output_tokens for r in none.collect()} == {"a": 7, "b": 0}


def test_cut_keeps_what_arrived(spark):
    rows = stream("a", [completion(t) for t in ("part-one ", "part-two ", "part-three")])
    chunks = spark.createDataFrame(rows, CHUNKS)
    cuts = spark.createDataFrame([("a", 1)], "call_id string, cut_seq bigint")
    assert assembly.assemble(assembly.until(chunks, cuts)).first().text == "part-one part-two "


def test_messages_stream(spark):
    events = [
        {"type": "message_start", "message": {"usage": {"input_tokens": 20}}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Hi "}},
        {"type": "content_block_delta", "delta": {"type": "input_json_delta", "text": "no"}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "there"}},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 5}},
        {"type": "message_stop"},
    ]
    row = assembled(spark, stream("m", map(json.dumps, events)), "messages")["m"]
    assert (row.text, row.input_tokens, row.output_tokens, row.stop_reason) == (
        "Hi there", 20, 5, "end_turn",
    )


def test_long_call_spans_blocks_in_any_input_order(spark):
    """A call of several blocks, its chunks shuffled, beside a call without text."""
    words = [f"w{i} " for i in range(3 * BLOCK + 17)]
    rows = stream("long", map(completion, words))
    rows = rows[::2][::-1] + rows[1::2] + stream("empty", [completion("")])
    got = assembled(spark, rows)
    assert got["long"].text == "".join(words) and got["long"].n_chunks == len(words)
    assert got["empty"].text == "" and got["empty"].first_text_at is None
    short = assembled(spark, rows, max_chars=500)
    assert short["long"].text == "".join(words)[:500]
    assert short["long"].n_chars == len("".join(words))


def test_router_response(spark):
    body = {
        "id": "gen-abc123",
        "provider": "Anthropic",
        "usage": {"prompt_tokens": 42, "completion_tokens": 11},
        "choices": [{"finish_reason": "stop", "message": {"content": "hi there"}}],
    }
    plain = {"choices": [{"message": {"content": None}}], "id": "", "usage": None}
    df = spark.createDataFrame([(0, json.dumps(body)), (1, json.dumps(plain))], "i int, response string")
    got = {r.i: r for r in responses.extract(df, shape="router").collect()}
    assert (got[0].input_tokens, got[0].output_tokens, got[0].output_text) == (42, 11, "hi there")
    assert json.loads(got[0].metadata) == {
        "system_fingerprint": None,
        "finish_reason": "stop",
        "openrouter_upstream": "Anthropic",
        "openrouter_generation_id": "gen-abc123",
    }
    assert (got[1].input_tokens, got[1].output_text) == (0, "")
    assert json.loads(got[1].metadata) == {"system_fingerprint": None, "finish_reason": None}


def test_messages_response(spark):
    body = {
        "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 2},
        "stop_reason": "end_turn",
        "content": [
            {"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"},
        ],
    }
    df = spark.createDataFrame([(json.dumps(body),), ("{}",)], "response string")
    first, second = responses.extract(df, shape="messages").collect()
    assert (first.input_tokens, first.output_tokens, first.output_text) == (3, 4, "ab")
    assert json.loads(first.metadata) == {
        "stop_reason": "end_turn", "cache_creation_input_tokens": None, "cache_read_input_tokens": 2,
    }
    assert (second.input_tokens, second.output_text) == (0, "")


@pytest.mark.parametrize(
    ("ruleset", "kind", "message", "expected"),
    [
        ("python", None, None, "SUCCESS"),
        ("python", "RuntimeError", "boom", "ERROR"),
        ("python", "CancelledError", "", "CANCELLED"),
        ("python", "KeyboardInterrupt", "", "CANCELLED"),
        ("python", "MyRateLimitError", "x", "RATE_LIMITED"),
        ("python", "HTTPError", "status 429", "RATE_LIMITED"),
        ("python", "RuntimeError", "request aborted", "ERROR"),
        ("web", "AbortError", "x", "CANCELLED"),
        ("web", "Error", "request Aborted", "CANCELLED"),
        ("web", "Error", "Rate-limit hit", "RATE_LIMITED"),
        ("web", "Error", "429", "RATE_LIMITED"),
        ("web", "Error", "boom", "ERROR"),
        ("web", None, None, "SUCCESS"),
    ],
)
def test_outcome(spark, ruleset, kind, message, expected):
    df = spark.createDataFrame([(kind, message)], "t string, m string")
    assert df.select(classify(F.col("t"), F.col("m"), ruleset)).first()[0] == expected


def requests(spark, rows):
    columns = (
        "call_id string, session_id string, message_id string, provider string, model string, "
        "started_at timestamp_ntz, ended_at timestamp_ntz, error_type string, error_message string, "
        "error_stack string, prompt string, metadata string"
    )
    return spark.createDataFrame(rows, columns)


def test_records(spark):
    call, lost = (f"00000000-0000-4000-8000-00000000000{i}" for i in (1, 2))
    end = START + timedelta(milliseconds=250)
    rows = requests(
        spark,
        [
            (call, call, None, "openai", "not-a-real-model", START, end, None, None, None,
             "x" * 1000, '{"turns":3}'),
            # a provider outside the contract: the record is dropped
            (lost, lost, None, "made-up", "m", START, end, None, None, None, None, None),
        ],
    )
    chunks = spark.createDataFrame(stream(call, [completion(""), completion("Hello")]), CHUNKS)
    for estimator in (None, lambda text: F.ceil(F.length(text) / 4)):
        (row,) = records.valid_only(records.build(rows, chunks, estimator=estimator)).collect()
        assert (row.request_status, row.latency_ms, row.ttft_ms) == ("SUCCESS", 250.0, 20.0)
        assert (len(row.input_preview), row.output_preview) == (500, "Hello")
        assert (row.input_tokens, row.output_tokens) == (250, 2)
        assert json.loads(row.metadata) == {
            "turns": 3, "cost_estimated": True, "cost_missing": True,
        }


def test_tokenizer_plugin(spark):
    rows = stream("b", [completion("one two"), completion(" three")])
    df = assembly.assemble(spark.createDataFrame(rows, CHUNKS))
    words = token_counter(lambda: lambda text: len(text.split()))
    assert assembly.backfill_usage(df, estimator=words).first().output_tokens == 3


@pytest.mark.parametrize(("max_chars", "levels"), [(1, 1), (7, 2), (40, 4)])
def test_blocks_of_blocks(spark, monkeypatch, max_chars, levels):
    """With tiny blocks a call passes through every level; the start stays the same."""
    monkeypatch.setattr(assembly, "BLOCK", 2)
    words = ["", "a", "", "bc ", "d", "", "", "efg", " h"] * 5
    rows = stream("x", map(completion, words)) + stream("y", [completion("z", (3, 4))])
    got = assembled(spark, rows[::-1], max_chars=max_chars, levels=levels)
    assert got["x"].text == "".join(words)[:max_chars]
    assert (got["x"].n_chars, got["x"].n_chunks) == (len("".join(words)), len(words))
    assert got["x"].first_text_at == START + timedelta(milliseconds=20)
    assert (got["y"].text, got["y"].input_tokens, got["y"].output_tokens) == ("z", 3, 4)
