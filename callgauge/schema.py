"""The data model: record fields, stored columns and the fixed vocabularies.

This module is the single definition of the telemetry contract. The validation
rules in ``operators.validation`` are generated from ``RECORD_FIELDS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: vocabularies of the telemetry contract ---------------------

PROVIDERS = ("openai", "anthropic", "google", "deepseek", "xai", "openrouter")
STATUSES = ("SUCCESS", "ERROR", "CANCELLED", "RATE_LIMITED")
MESSAGE_ROLES = ("user", "assistant", "system", "tool")

PREVIEW_CHARS = 500
LIST_PREVIEW_CHARS = 160
AUTO_TITLE_CHARS = 60
MODEL_CHARS = 100
USERNAME_CHARS = 64
TITLE_CHARS = 255
MESSAGE_CHARS = 200_000
BACKLOG_LIMIT = 100_000
MAX_LOAD_ATTEMPTS = 3

# (provider, model, USD per 1000 input tokens, USD per 1000 output tokens)
PRICES = (
    ("openai", "gpt-4o", 0.0025, 0.01),
    ("openai", "gpt-4o-2024-08-06", 0.0025, 0.01),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai", "gpt-4-turbo", 0.01, 0.03),
    ("openai", "gpt-3.5-turbo", 0.0005, 0.0015),
    ("anthropic", "claude-3-5-sonnet-latest", 0.003, 0.015),
    ("anthropic", "claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("anthropic", "claude-3-5-haiku-latest", 0.001, 0.005),
    ("anthropic", "claude-3-opus-latest", 0.015, 0.075),
    ("google", "gemini-1.5-pro", 0.00125, 0.005),
    ("google", "gemini-1.5-flash", 0.000075, 0.0003),
    ("deepseek", "deepseek-chat", 0.00014, 0.00028),
    ("xai", "grok-2", 0.002, 0.01),
    ("openrouter", "openai/gpt-4o", 0.0025, 0.01),
    ("openrouter", "openai/gpt-4o-mini", 0.00015, 0.0006),
    ("openrouter", "anthropic/claude-3.5-sonnet", 0.003, 0.015),
    ("openrouter", "anthropic/claude-3-5-sonnet", 0.003, 0.015),
    ("openrouter", "anthropic/claude-3.5-haiku", 0.001, 0.005),
    ("openrouter", "google/gemini-1.5-pro", 0.00125, 0.005),
    ("openrouter", "google/gemini-1.5-flash", 0.000075, 0.0003),
    ("openrouter", "deepseek/deepseek-chat", 0.00014, 0.00028),
    ("openrouter", "x-ai/grok-2", 0.002, 0.01),
    ("openrouter", "meta-llama/llama-3.1-70b-instruct", 0.00088, 0.00088),
    ("openrouter", "mistralai/mistral-large", 0.003, 0.009),
)

# model -> number of non-system turns kept in its context window
TURN_CAPS = {
    "gpt-4o": 30,
    "gpt-4o-mini": 60,
    "claude-3-5-sonnet-latest": 30,
    "claude-3-5-haiku-latest": 60,
    "gemini-1.5-pro": 40,
    "gemini-1.5-flash": 80,
    "deepseek-chat": 40,
    "grok-2": 30,
}
DEFAULT_TURN_CAP = 20

# provider -> models a chat request may ask for
MODEL_REGISTRY = {
    "openai": ("gpt-4o", "gpt-4o-mini"),
    "anthropic": ("claude-3-5-sonnet-latest", "claude-3-5-haiku-latest"),
    "google": ("gemini-1.5-pro", "gemini-1.5-flash"),
    "deepseek": ("deepseek-chat",),
    "xai": ("grok-2",),
    "openrouter": (
        "openai/gpt-4o",
        "openai/gpt-4o-mini",
        "anthropic/claude-3.5-sonnet",
        "anthropic/claude-3.5-haiku",
        "google/gemini-1.5-pro",
        "google/gemini-1.5-flash",
        "deepseek/deepseek-chat",
        "x-ai/grok-2",
        "meta-llama/llama-3.1-70b-instruct",
        "mistralai/mistral-large",
    ),
}

# names that look like personal data to a scanner but are not
ALLOWED_TOKENS = (
    "openai",
    "anthropic",
    "google",
    "deepseek",
    "xai",
    "claude",
    "gpt",
    "gemini",
    "grok",
    "sonnet",
    "haiku",
    "opus",
)

UUID_PATTERN = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"

# --- end of fixed values -------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One field of the telemetry record and the rules it must satisfy."""

    name: str
    kind: str  # uuid | text | number | integer | instant | object
    required: bool = True
    choices: tuple[str, ...] | None = None
    min_chars: int | None = None
    max_chars: int | None = None
    column: str | None = None  # stored column, when it is renamed on load

    @property
    def stored(self) -> str:
        return self.column or self.name


RECORD_FIELDS = (
    Field("log_id", "uuid", column="id"),
    Field("session_id", "uuid"),
    Field("message_id", "uuid", required=False),
    Field("provider", "text", choices=PROVIDERS),
    Field("model", "text", min_chars=1, max_chars=MODEL_CHARS),
    Field("request_status", "text", choices=STATUSES, column="status"),
    Field("latency_ms", "number"),
    Field("ttft_ms", "number", required=False),
    Field("input_tokens", "integer"),
    Field("output_tokens", "integer"),
    Field("total_cost", "number"),
    Field("error_stack", "text", required=False),
    Field("input_preview", "text", required=False, max_chars=PREVIEW_CHARS),
    Field("output_preview", "text", required=False, max_chars=PREVIEW_CHARS),
    Field("timestamp", "instant", column="created_at"),
    Field("metadata", "object", required=False),
)

FEED_SCHEMA = T.StructType(
    [
        T.StructField("origin_id", T.StringType(), False),
        T.StructField("payload", T.StringType(), True),
        T.StructField("arrived_at", T.TimestampNTZType(), True),
    ]
)

CALLS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("message_id", T.StringType(), True),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("latency_ms", T.DoubleType(), False),
        T.StructField("ttft_ms", T.DoubleType(), True),
        T.StructField("input_tokens", T.IntegerType(), False),
        T.StructField("output_tokens", T.IntegerType(), False),
        T.StructField("total_cost", T.DoubleType(), False),
        T.StructField("error_stack", T.StringType(), True),
        T.StructField("input_preview", T.StringType(), True),
        T.StructField("output_preview", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("metadata", T.StringType(), False),
    ]
)
CALL_COLUMNS = tuple(CALLS_SCHEMA.fieldNames())

USERS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("last_seen_at", T.TimestampNTZType(), False),
    ]
)
SESSIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ]
)
MESSAGES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)
CHUNKS_SCHEMA = T.StructType(
    [
        T.StructField("call_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("chunk", T.StringType(), True),
    ]
)
