"""Assembly of telemetry records from requests and their streamed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.instants import elapsed_ms, iso
from callgauge.functions.metadata import merge_objects
from callgauge.functions.outcome import classify
from callgauge.functions.text import estimated_tokens, preview
from callgauge.operators import assembly, validation
from callgauge.operators.pricing import with_cost
from callgauge.schema import PREVIEW_CHARS, RECORD_FIELDS


def _members(estimated: bool) -> Column:
    """Metadata members the assembly itself contributes; absent ones are left out."""
    return F.to_json(
        F.struct(
            F.col("stop_reason").alias("stop_reason"),
            F.when(F.col("cost_estimated"), F.lit(True)).alias("cost_estimated")
            if estimated
            else F.lit(None).cast("boolean").alias("cost_estimated"),
            F.when(F.col("cost_missing"), F.lit(True)).alias("cost_missing"),
        )
    )


def build(
    requests: DataFrame,
    chunks: DataFrame,
    shape: str = "completion",
    prices: DataFrame | None = None,
    ruleset: str = "python",
    estimator: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One telemetry record per request.

    ``requests``: call_id, session_id, message_id, provider, model, started_at,
    ended_at, error_type, error_message, error_stack, prompt, metadata.

    Text is only kept as far as the preview shows it. The default token estimate
    needs the length of the whole text and nothing else; a custom ``estimator``
    needs the text itself, so then the whole text is assembled.
    """
    whole = estimator is not None
    answers = assembly.assemble(chunks, shape, max_chars=None if whole else PREVIEW_CHARS)
    joined = requests.join(answers, "call_id", "left").withColumns(
        {"text": F.coalesce("text", F.lit("")), "n_chars": F.coalesce("n_chars", F.lit(0))}
    )
    estimated = shape == "completion"
    if not estimated:
        counted = assembly.fill_usage(joined)
    elif whole:
        counted = assembly.backfill_usage(joined, estimator, prompt="prompt")
    else:
        missing = F.col("input_tokens").isNull() & F.col("output_tokens").isNull()
        by_length = F.ceil(F.col("n_chars") / 4).cast("int")
        counted = joined.withColumns(
            {
                "cost_estimated": missing,
                "input_tokens": F.when(missing, estimated_tokens(F.col("prompt"))).otherwise(
                    F.coalesce("input_tokens", F.lit(0))
                ),
                "output_tokens": F.when(missing, by_length).otherwise(
                    F.coalesce("output_tokens", F.lit(0))
                ),
            }
        )
    priced = with_cost(counted, prices)
    return priced.select(
        F.col("call_id").alias("log_id"),
        "session_id",
        "message_id",
        "provider",
        "model",
        classify(F.col("error_type"), F.col("error_message"), ruleset).alias("request_status"),
        elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
        elapsed_ms(F.col("started_at"), F.col("first_text_at")).alias("ttft_ms"),
        "input_tokens",
        "output_tokens",
        "total_cost",
        "error_stack",
        preview(F.col("prompt")).alias("input_preview"),
        F.when(F.col("text") != "", preview(F.col("text"))).alias("output_preview"),
        F.col("started_at").alias("timestamp"),
        merge_objects(F.col("metadata"), _members(estimated)).alias("metadata"),
    )


def to_payload(records: DataFrame) -> DataFrame:
    """Feed rows: every record as one JSON payload keyed by its log id."""
    fields = [
        F.col(f.name)
        if f.kind not in ("instant", "object")
        else iso(F.col(f.name)).alias(f.name)
        if f.kind == "instant"
        else F.parse_json(f.name).alias(f.name)
        for f in RECORD_FIELDS
    ]
    return records.select(
        F.col("log_id").alias("origin_id"),
        F.to_json(F.struct(*fields)).alias("payload"),
        F.col("timestamp").alias("arrived_at"),
    )


def valid_only(records: DataFrame) -> DataFrame:
    """Checked records; one that breaks a rule is dropped, as its sender would do."""
    return validation.good(validation.check(to_payload(records))).select("record.*")
