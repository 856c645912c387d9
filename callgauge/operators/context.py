"""The context window a model sees of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgauge.schema import DEFAULT_TURN_CAP, TURN_CAPS
from callgauge.sources import catalogs


def with_cap(turns: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Add the model's turn cap; models without one get the default."""
    table = F.broadcast(catalogs.turn_caps(turns.sparkSession)) if caps is None else caps
    joined = turns.join(table, "model", "left")
    return joined.withColumn("cap", F.coalesce("cap", F.lit(DEFAULT_TURN_CAP)))


def context_window(
    turns: DataFrame, cap: int | None = None, caps: DataFrame | None = None, max_cap: int | None = None
) -> DataFrame:
    """First system turn, then the last *cap* other turns, per conversation.

    ``turns`` has (conv_id, turn, role, text) and, unless a fixed ``cap`` is given,
    ``model``. Adds ``position`` (1 = first turn shown).

    System and other turns are ranked in one window keyed by (conversation, kind).
    The constant bound ``max_cap`` lets each map task drop the turns that cannot be
    in the window before the exchange; pass it along with custom ``caps``.
    """
    if cap is not None:
        capped = turns.withColumn("cap", F.lit(cap))
        most = cap
    else:
        if caps is not None and max_cap is None:
            raise ValueError("custom caps need max_cap, their largest value")
        capped = with_cap(turns, caps)
        # models without an entry have the default, whatever the entries say
        most = max(DEFAULT_TURN_CAP, *([max_cap] if caps is not None else TURN_CAPS.values()))
        too_low = F.raise_error(F.lit(f"a cap exceeds max_cap, {most}")).cast("int")
        capped = capped.withColumn(
            "cap", F.when(F.col("cap") > most, too_low).otherwise(F.col("cap"))
        )
    is_system = F.col("role") == "system"
    kind = W.partitionBy("conv_id", "is_system").orderBy("distance")
    kept = (
        capped.withColumn("is_system", is_system)
        .withColumn("distance", F.when(is_system, F.col("turn")).otherwise(-F.col("turn")))
        .withColumn("rank", F.row_number().over(kind))
        .where(F.col("rank") <= max(most, 1))
        .where(F.col("rank") <= F.when(F.col("is_system"), F.lit(1)).otherwise(F.col("cap")))
    )
    # at most max_cap + 1 rows per conversation are left
    shown = W.partitionBy("conv_id").orderBy(F.col("is_system").desc(), "turn")
    return kept.withColumn("position", F.row_number().over(shown)).drop(
        "is_system", "distance", "rank", "cap"
    )


def last_user_message(windowed: DataFrame) -> DataFrame:
    """Per conversation: turns shown, and the last user text among them."""
    last = F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))
    return windowed.groupBy("conv_id").agg(
        F.count("*").alias("turns"), last["text"].alias("last_user_text")
    )
