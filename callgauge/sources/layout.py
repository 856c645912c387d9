"""Rows ordered so that filters on any of several columns skip most of a table.

Sorted by one column, a file's statistics are narrow for that column only. A Z-order key
takes bits of the columns' positions in turn, so rows of a file are near each other in every
one of them. Positions are places between quantiles, so skewed columns and strings without
spread (ids with a common prefix) are cut evenly as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# rows looked at for the quantiles; they decide where rows lie, never which there are
SAMPLE = 20_000
# bits per column: 2 ** BITS places each
BITS = 5


def bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """Per column at most 2 ** bits - 1 ascending values that cut it into even places.

    A frequent value takes up several quantiles but is one bound. About ``sample`` rows are
    collected, whatever the size of the table.
    """
    rows = df.select(*columns)
    share = min(1.0, sample / max(1, rows.count()))
    drawn = (rows.sample(share, seed=7) if share < 1 else rows).limit(2 * sample).collect()
    cuts = {}
    for c in columns:
        values = sorted(r[c] for r in drawn if r[c] is not None)
        places = 2**bits
        steps = [values[len(values) * n // places] for n in range(1, places)] if values else []
        # the smallest value would cut off nothing
        cuts[c] = [v for v in dict.fromkeys(steps) if v > values[0]]
    return cuts


def place(column: str, cuts: Sequence, kind: T.DataType) -> Column:
    """How many of the ascending ``cuts`` a value has reached; none for NULL."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.lit(v).cast(kind) for v in cuts])
    reached = F.size(F.filter(listed, lambda cut: cut <= F.col(column)))
    return F.coalesce(F.when(F.col(column).isNotNull(), reached), F.lit(0))


def z_key(df: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> Column:
    """The Z-order key of the rows of ``df``: bits of all columns in turn, as a bigint."""
    if bits * len(columns) > 62:
        raise ValueError("bits of all columns must fit into 62")
    cuts = bounds(df, columns, bits, sample)
    key = F.lit(0).cast("bigint")
    for n, c in enumerate(columns):
        at = place(c, cuts[c], df.schema[c].dataType).cast("bigint")
        # positions of a column with few values use the upper bits, like those of the others
        at = F.shiftleft(at, bits - max(1, len(cuts[c]).bit_length()))
        for b in range(bits):
            bit = F.shiftright(at, b).bitwiseAND(1)
            key = key.bitwiseOR(F.shiftleft(bit, b * len(columns) + n))
    return key
