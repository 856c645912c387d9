"""Gapless numbers for rows in a global order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.session import broadcast_if_small

_ROW, _SEQ, _PART = "__row_id", "__seq", "__part"


def numbered(rows: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their group by ``order``, and ``n``, its size.

    Rows are dealt by ranges of (group, order) and sorted per range, so a group of any size
    spreads over many tasks; only one count per range and group is added up. Null sorts first
    and is a group like any other. Rows that are equal in the whole order follow each other
    as they are stored; a row identifier added first keeps even these apart in the ranges.
    """
    kept = rows.columns
    keys = [*group, *order, _ROW]
    # stored, so that a repeated task finds the same identifiers
    known = stored(rows.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    # the upper bits of the sequence name the range, the lower ones count within it
    placed = stored(
        known.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*kept, F.monotonically_increasing_id().alias(_SEQ)),
        "ranges",
    ).withColumn(_PART, F.shiftright(_SEQ, 33))
    runs = placed.groupBy(_PART, *group).agg(F.min(_SEQ).alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col(_PART).alias("__part_of"),
        *(F.col(g).alias(f"__group_{i}") for i, g in enumerate(group)),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("__shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = F.col(_PART) == F.col("__part_of")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__group_{i}"))
    return placed.join(broadcast_if_small(starts), same).select(
        *kept, (F.col(_SEQ) + F.col("__shift")).alias("pos"), "n"
    )
