"""From streamed chunks to one row per call.

A call's chunks are folded in two steps. Chunks are first grouped by call *and*
block of consecutive sequence numbers, so even a call that owns a third of all
chunks is spread over many tasks and reaches the final step as one short row per
block. Blocks are then joined in order. Every other output (usage, first token,
lengths) is a maximum, minimum or sum and folds the same way.

Sequence numbers are unique within a call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.text import estimated_tokens
from callgauge.operators.responses import parse_chunks

# a call of 16 million chunks ends in a group of as many short rows as a block has chunks
BLOCK = 4096


def _joined(position: str, text: str, max_chars: int | None) -> Column:
    """Texts of a group in order, without the empty ones."""
    piece = F.when(F.col(text) != "", F.struct(F.col(position), F.col(text)))
    pieces = F.array_sort(F.collect_list(piece))
    whole = F.array_join(F.transform(pieces, lambda p: p[text]), "")
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def until(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Only the chunks that arrived before a call was cut short.

    ``cuts`` has (call_id, cut_seq); the chunk with that number is the last one
    kept. Calls without a cut keep all chunks.
    """
    marked = chunks.join(cuts.select("call_id", "cut_seq"), "call_id", "left")
    kept = marked.where(F.col("cut_seq").isNull() | (F.col("seq") <= F.col("cut_seq")))
    return kept.select(*chunks.columns)


def latest(value: Column, seq: Column) -> Column:
    """The value on the highest sequence number that has one."""
    return F.max(F.when(value.isNotNull(), F.struct(seq.alias("seq"), value.alias("value"))))


def assemble(
    chunks: DataFrame, shape: str = "completion", max_chars: int | None = None, levels: int = 1
) -> DataFrame:
    """One row per call.

    Columns: ``text`` (all text in order, or its first ``max_chars`` characters),
    ``n_chars`` (of the whole text), ``input_tokens`` / ``output_tokens`` (last ones
    seen, NULL if none), ``stop_reason``, ``first_text_at`` (NULL without text),
    ``last_at`` and ``n_chunks``.

    With ``max_chars`` every block is cut to that length as well; the first
    characters of the whole need no more than that from any block, so the result is
    the same, and rows stay short. Every level of blocks costs an exchange; more than one
    is of use only with ``max_chars`` and calls of far more than ``BLOCK ** 2`` chunks.
    """
    carried = ("input_tokens", "output_tokens", "stop_reason")
    rows = parse_chunks(chunks, shape).select(
        "call_id",
        F.col("seq").alias("position"),
        "text",
        F.length("text").cast("bigint").alias("n_chars"),
        *[
            F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value"))).alias(c)
            for c in carried
        ],
        F.when(F.col("text") != "", F.struct("seq", "ts")).alias("first_text"),
        F.col("ts").alias("last_at"),
        F.lit(1).cast("bigint").alias("n_chunks"),
    )
    folded = [
        _joined("position", "text", max_chars).alias("text"),
        F.sum("n_chars").alias("n_chars"),
        *[F.max(c).alias(c) for c in carried],
        F.min("first_text").alias("first_text"),
        F.max("last_at").alias("last_at"),
        F.sum("n_chunks").alias("n_chunks"),
    ]
    for _ in range(levels):
        block = F.floor(F.col("position") / BLOCK).alias("position")
        rows = rows.groupBy("call_id", block).agg(*folded)
    return (
        rows.groupBy("call_id")
        .agg(*folded)
        .select(
            "call_id",
            "text",
            "n_chars",
            *[F.col(c)["value"].alias(c) for c in carried],
            F.col("first_text")["ts"].alias("first_text_at"),
            "last_at",
            "n_chunks",
        )
    )


def backfill_usage(
    assembled: DataFrame,
    estimator: Callable[[Column], Column] = estimated_tokens,
    text: str = "text",
    prompt: str | None = None,
) -> DataFrame:
    """Estimate token counts where no usage arrived and mark those rows.

    Adds ``cost_estimated``. An estimator that returns NULL counts as 0; without a
    prompt the input estimate is 0.
    """
    missing = F.col("input_tokens").isNull() & F.col("output_tokens").isNull()
    prompt_estimate = F.lit(0) if prompt is None else _estimate(estimator, F.col(prompt))
    text_estimate = _estimate(estimator, F.col(text))
    return assembled.select(
        *[c for c in assembled.columns if c not in ("input_tokens", "output_tokens")],
        F.when(missing, prompt_estimate)
        .otherwise(F.coalesce("input_tokens", F.lit(0)))
        .alias("input_tokens"),
        F.when(missing, text_estimate)
        .otherwise(F.coalesce("output_tokens", F.lit(0)))
        .alias("output_tokens"),
        missing.alias("cost_estimated"),
    )


def _estimate(estimator: Callable[[Column], Column], text: Column) -> Column:
    estimate = F.coalesce(estimator(text).cast("int"), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(estimate)


def fill_usage(assembled: DataFrame) -> DataFrame:
    """Zero for token counts that never arrived (the messages shape does not estimate)."""
    return assembled.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    )
