"""Joins that treat NULL as a value, as GROUP BY does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_keys: bool = True,
) -> DataFrame:
    """Join two frames on group keys; the result has the keys once.

    Keys known to hold no NULL (``null_keys=False``) are compared with plain equality,
    so a side that is already partitioned by them is not exchanged again.
    """
    if not null_keys:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_right_{k}" for k in keys])
