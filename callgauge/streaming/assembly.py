"""Live assembly of streamed chunks.

``assemble_stream`` keeps the whole text of open calls. The end of a call is not
visible in a chunk table, so a call is finished when no chunk arrived for ``gap`` and
the watermark has passed that point.

``preview_stream`` keeps only what a record shows of a call, so its state is bounded
whatever the length of a call, and it emits a call as soon as its terminal event
arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callgauge.operators.assembly import _joined, latest
from callgauge.operators.responses import parse_chunks
from callgauge.schema import PREVIEW_CHARS

# instants travel as microseconds since 1970
STATE = """
    seqs array<bigint>, texts array<string>, n_chars bigint, n_chunks bigint,
    input_seq bigint, input_tokens int, output_seq bigint, output_tokens int,
    stop_seq bigint, stop_reason string, first_seq bigint, first_at bigint, last_at bigint
"""
PREVIEW = """
    call_id string, text string, n_chars bigint, input_tokens int, output_tokens int,
    stop_reason string, first_text_at bigint, last_at bigint, n_chunks bigint, complete boolean
"""


def assemble_stream(
    chunks: DataFrame, shape: str = "completion", gap: str = "10 minutes", delay: str = "1 minute"
) -> DataFrame:
    """One row per call and burst of chunks; columns as in the batch assembly."""
    timed = chunks.withColumn("event_time", F.col("ts").cast("timestamp"))
    parsed = parse_chunks(timed, shape).withWatermark("event_time", delay)
    has_text = F.col("text") != ""
    rows = parsed.groupBy("call_id", F.session_window("event_time", gap)).agg(
        _joined("seq", "text", None).alias("text"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
        *[
            latest(F.col(c), F.col("seq"))["value"].alias(c)
            for c in ("input_tokens", "output_tokens", "stop_reason")
        ],
        F.min(F.when(has_text, F.struct("seq", "ts")))["ts"].alias("first_text_at"),
        F.max("ts").alias("last_at"),
        F.count("*").alias("n_chunks"),
    )
    return rows.drop("session_window")


def preview_stream(
    chunks: DataFrame,
    shape: str = "completion",
    gap_seconds: int = 600,
    delay: str = "1 minute",
    max_chars: int = PREVIEW_CHARS,
) -> DataFrame:
    """One row per call with the first ``max_chars`` characters of its text.

    Columns as in the batch assembly, plus ``complete``: whether the terminal event of
    the messages shape was seen. Without one a call is emitted after the gap. Chunks
    may arrive in any order; one that arrives after its call was emitted starts a new
    row.
    """
    ends = F.get_json_object("chunk", "$.type") == "message_stop" if shape == "messages" else F.lit(False)
    timed = chunks.withColumns({"event_time": F.col("ts").cast("timestamp"), "ends": ends})
    parsed = (
        parse_chunks(timed, shape)
        .withWatermark("event_time", delay)
        .select(
            "call_id",
            "seq",
            "text",
            "input_tokens",
            "output_tokens",
            "stop_reason",
            F.coalesce("ends", F.lit(False)).alias("ends"),
            F.unix_micros("event_time").alias("at"),
            "event_time",
        )
    )
    rows = parsed.groupBy("call_id").applyInPandasWithState(
        _preview_step(gap_seconds * 1000, max_chars),
        PREVIEW,
        STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return rows.withColumns(
        {c: F.timestamp_add("MICROSECOND", F.col(c), epoch) for c in ("first_text_at", "last_at")}
    )


def _preview_step(gap_ms: int, max_chars: int):
    """The state transition of one call."""

    def first_pieces(seqs, texts):
        """The earliest pieces that together reach the wanted length; later ones can
        never show, since an earlier piece only pushes them further back."""
        kept, size = [], 0
        for seq, text in sorted(zip(seqs, texts, strict=True)):
            if size >= max_chars:
                break
            kept.append((seq, text[:max_chars]))
            size += len(text)
        return kept

    def last(frame: pd.DataFrame, column: str, seq, value):
        seen = frame[frame[column].notna()]
        if len(seen):
            newest = seen.loc[seen["seq"].idxmax()]
            if seq is None or newest["seq"] > seq:
                return int(newest["seq"]), newest[column]
        return seq, value

    def whole(value):
        return None if value is None else int(value)

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.exists:
            seqs, texts, chars, count, in_s, in_t, out_s, out_t, st_s, st, f_s, f_at, l_at = state.get
        else:
            seqs, texts, chars, count = [], [], 0, 0
            in_s = in_t = out_s = out_t = st_s = st = f_s = f_at = l_at = None
        ended = False
        for frame in frames:
            if frame.empty:  # a timeout comes without rows
                continue
            said = frame[frame["text"] != ""]
            pieces = first_pieces(
                list(seqs) + [int(q) for q in said["seq"]], list(texts) + said["text"].tolist()
            )
            seqs, texts = [q for q, _ in pieces], [t for _, t in pieces]
            chars += int(said["text"].str.len().sum())
            count += len(frame)
            in_s, in_t = last(frame, "input_tokens", in_s, in_t)
            out_s, out_t = last(frame, "output_tokens", out_s, out_t)
            st_s, st = last(frame, "stop_reason", st_s, st)
            if len(said):
                earliest = said.loc[said["seq"].idxmin()]
                if f_s is None or earliest["seq"] < f_s:
                    f_s, f_at = int(earliest["seq"]), int(earliest["at"])
            newest_at = int(frame["at"].max())
            l_at = newest_at if l_at is None else max(l_at, newest_at)
            ended = ended or bool(frame["ends"].any())
        if ended or state.hasTimedOut:
            state.remove()
            text = "".join(texts)[:max_chars]
            row = (key[0], text, chars, whole(in_t), whole(out_t), st, f_at, l_at, count, ended)
            yield pd.DataFrame([row], columns=_PREVIEW_COLUMNS).astype(_PREVIEW_TYPES)
        else:
            state.update(
                (seqs, texts, chars, count, in_s, whole(in_t), out_s, whole(out_t), st_s, st, f_s, f_at, l_at)
            )
            # the watermark may already have passed the gap
            due = max(l_at // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(due)

    return step


_PREVIEW_COLUMNS = [part.split()[0] for part in PREVIEW.split(",")]
_PREVIEW_TYPES = {
    "input_tokens": "Int32",
    "output_tokens": "Int32",
    "first_text_at": "Int64",
    "last_at": "Int64",
}


def write(
    assembled: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append finished calls to a Parquet table, each exactly once."""
    writer = (
        assembled.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
