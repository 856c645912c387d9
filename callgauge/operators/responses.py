"""Usage, text and metadata from provider responses and streamed chunks.

Responses and chunks arrive as JSON text. Numbers are read as doubles and cut to
integers, because a provider may write ``12.0`` where it means 12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the parts of each response shape that are read --------------
COMPLETION = """
    id STRING, provider STRING, system_fingerprint STRING,
    usage STRUCT<prompt_tokens: DOUBLE, completion_tokens: DOUBLE>,
    choices ARRAY<STRUCT<finish_reason: STRING, message: STRUCT<content: STRING>>>
"""
MESSAGES = """
    stop_reason STRING,
    usage STRUCT<input_tokens: DOUBLE, output_tokens: DOUBLE,
                 cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT>,
    content ARRAY<STRUCT<type: STRING, text: STRING>>
"""
COMPLETION_CHUNK = """
    usage STRUCT<prompt_tokens: DOUBLE, completion_tokens: DOUBLE>,
    choices ARRAY<STRUCT<delta: STRUCT<content: STRING>>>
"""
MESSAGES_EVENT = """
    type STRING,
    message STRUCT<usage: STRUCT<input_tokens: DOUBLE>>,
    delta STRUCT<type: STRING, text: STRING, stop_reason: STRING>,
    usage STRUCT<output_tokens: DOUBLE>
"""
# --- end of fixed values ----------------------------------------------------------

KEEP_NULLS = {"ignoreNullFields": "false"}


def _tokens(count: Column) -> Column:
    return F.coalesce(count, F.lit(0.0)).cast("int")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _member_if_set(name: str, value: Column) -> Column:
    """A one-entry map, or an empty one when the value is NULL or empty."""
    entry = F.create_map(F.lit(name), value)
    nothing = F.expr("CAST(map() AS map<string,string>)")
    return F.when(_text(value) != "", entry).otherwise(nothing)


def _completion(r: Column, router: bool) -> dict[str, Column]:
    first = F.get(r["choices"], F.lit(0))
    metadata = F.create_map(
        F.lit("system_fingerprint"),
        r["system_fingerprint"],
        F.lit("finish_reason"),
        first["finish_reason"],
    )
    if router:
        metadata = F.map_concat(
            metadata,
            _member_if_set("openrouter_upstream", r["provider"]),
            _member_if_set("openrouter_generation_id", r["id"]),
        )
    return {
        "input_tokens": _tokens(r["usage"]["prompt_tokens"]),
        "output_tokens": _tokens(r["usage"]["completion_tokens"]),
        "output_text": _text(first["message"]["content"]),
        "metadata": F.to_json(metadata),
    }


def _messages(r: Column) -> dict[str, Column]:
    texts = F.transform(
        F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: _text(b["text"])
    )
    metadata = F.struct(
        r["stop_reason"].alias("stop_reason"),
        r["usage"]["cache_creation_input_tokens"].alias("cache_creation_input_tokens"),
        r["usage"]["cache_read_input_tokens"].alias("cache_read_input_tokens"),
    )
    return {
        "input_tokens": _tokens(r["usage"]["input_tokens"]),
        "output_tokens": _tokens(r["usage"]["output_tokens"]),
        "output_text": _text(F.array_join(texts, "")),
        "metadata": F.to_json(metadata, KEEP_NULLS),
    }


def extract(responses: DataFrame, column: str = "response", shape: str = "completion") -> DataFrame:
    """Replace the response by input/output tokens, output text and metadata.

    ``shape`` is ``completion``, ``messages`` or ``router`` (a completion that also
    names its upstream provider and generation id).
    """
    kept = [c for c in responses.columns if c != column]
    layout = MESSAGES if shape == "messages" else COMPLETION
    parsed = responses.withColumn("_r", F.from_json(F.col(column), layout))
    if shape == "messages":
        parts = _messages(F.col("_r"))
    elif shape in ("completion", "router"):
        parts = _completion(F.col("_r"), router=shape == "router")
    else:
        raise ValueError(f"unknown response shape {shape!r}")
    return parsed.select(*kept, *[value.alias(name) for name, value in parts.items()])


def parse_chunks(chunks: DataFrame, shape: str = "completion") -> DataFrame:
    """Per chunk: ``text`` ('' if none), ``input_tokens`` / ``output_tokens`` / ``stop_reason``.

    The last three are NULL on chunks that do not carry them.
    """
    layout = COMPLETION_CHUNK if shape == "completion" else MESSAGES_EVENT
    kept = [c for c in chunks.columns if c != "chunk"]
    parsed = chunks.withColumn("_c", F.from_json(F.col("chunk"), layout))
    c = F.col("_c")
    if shape == "completion":
        has_usage = c["usage"].isNotNull()
        parts = {
            "text": _text(F.get(c["choices"], F.lit(0))["delta"]["content"]),
            "input_tokens": F.when(has_usage, _tokens(c["usage"]["prompt_tokens"])),
            "output_tokens": F.when(has_usage, _tokens(c["usage"]["completion_tokens"])),
            "stop_reason": F.lit(None).cast("string"),
        }
    elif shape == "messages":
        started = c["type"] == "message_start"
        text = (c["type"] == "content_block_delta") & (c["delta"]["type"] == "text_delta")
        ended = c["type"] == "message_delta"
        start_usage, end_usage = c["message"]["usage"], c["usage"]
        parts = {
            "text": F.when(text, _text(c["delta"]["text"])).otherwise(F.lit("")),
            "input_tokens": F.when(
                started & start_usage.isNotNull(), _tokens(start_usage["input_tokens"])
            ),
            "output_tokens": F.when(
                ended & end_usage.isNotNull(), _tokens(end_usage["output_tokens"])
            ),
            "stop_reason": F.when(ended, c["delta"]["stop_reason"]),
        }
    else:
        raise ValueError(f"unknown chunk shape {shape!r}")
    return parsed.select(*kept, *[value.alias(name) for name, value in parts.items()])
