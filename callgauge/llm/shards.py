"""Reproducible shuffle of a table into shards, by a Feistel permutation of its row numbers.

Rows get gapless global numbers in a stated order. A Feistel network permutes the numbers
below the next power of two; numbers that land outside the table walk on along their cycle
until they are inside, which permutes the row numbers themselves. The permuted number, dealt
round robin, is shard and slot. So the shuffle depends on the rows, their order and the seed
alone, shard sizes differ by one row at most, and the place of any row number, as well as
the row number at any place, follows by arithmetic (``place`` and ``row_at``).

Defined results: an empty table has no rows; null and repeated keys are numbered like any
other; of rows equal in the whole order any may come first, so the order should tell them
apart; columns of the input that are called like an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.numbering import numbered

SHARDS = 24
SEED = 20_260_501
ROUNDS = 6  # even, so that halves of unequal width end where they began
MASK = (1 << 31) - 1
# odd multipliers below 2**30: products with a 31-bit number fit a signed 64-bit one
MIX_A, MIX_B = 0x2C1B3C6D, 0x297A2D39


def round_keys(seed: int) -> list[int]:
    """One 31-bit number per round."""
    digests = (hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(ROUNDS))
    return [int.from_bytes(d[:4], "big") & MASK for d in digests]


def widths(total: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest network that holds ``total`` numbers."""
    if total > 1 << 62:
        raise ValueError("at most 2**62 rows")
    bits = max(2, (total - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + key) & MASK
    x = ((x ^ (x >> 15)) * MIX_A) & MASK
    x = ((x ^ (x >> 12)) * MIX_B) & MASK
    return x ^ (x >> 15)


def _network(values: np.ndarray, total: int, seed: int) -> np.ndarray:
    a, b = widths(total)
    left, right = values >> b, values & ((1 << b) - 1)
    for key in round_keys(seed):
        left, right = right, (left + _mixed(right, key)) & ((1 << a) - 1)
        a, b = b, a
    return (left << b) | right


def _network_back(values: np.ndarray, total: int, seed: int) -> np.ndarray:
    a, b = widths(total)
    left, right = values >> b, values & ((1 << b) - 1)
    for key in reversed(round_keys(seed)):
        a, b = b, a
        left, right = (right - _mixed(left, key)) & ((1 << a) - 1), left
    return (left << b) | right


def _walked(step, values: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Along each number's cycle to the first number below ``total``; cycles end inside."""
    out = step(values.astype(np.int64), total, seed)
    while len(outside := np.flatnonzero(out >= total)):
        out[outside] = step(out[outside], total, seed)
    return out


def permuted(numbers: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """A permutation of 0 .. total - 1."""
    return _walked(_network, numbers, total, seed)


def place(number: int, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = int(permuted(np.array([number]), total, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, total: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a place: a reader can ask for any one sample of the shuffle."""
    at = np.array([slot * shards + shard])
    if not 0 <= at[0] < total or not 0 <= shard < shards:
        raise IndexError("no such place")
    return int(_walked(_network_back, at, total, seed)[0])


def permuted_column(number: str | Column, total: str | Column, seed: int = SEED) -> Column:
    """``permuted`` for columns; ``total`` must be the same on every row."""

    @F.arrow_udf(T.LongType())
    def run(numbers: pa.Array, totals: pa.Array) -> pa.Array:
        if not len(numbers):
            return pa.array([], type=pa.int64())
        return pa.array(permuted(numbers.to_numpy(), totals[0].as_py(), seed))

    return run(number, total)


def assign(
    docs: DataFrame, *, order_by: Sequence[str], shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """All rows with ``row_number`` (from 0 by ``order_by``), ``shard`` and ``slot`` (from 0).

    Rows move once, by ranges of the order: pass the columns that are needed, not more.
    """
    added = ("row_number", "shard", "slot")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *(F.col(c).alias(f"key_{i}") for i, c in enumerate(order_by)),
    )
    at = numbered(rows, [f"key_{i}" for i in range(len(order_by))]).withColumn(
        "at", permuted_column("pos", "n", seed)
    )
    return at.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in added),
        F.col("pos").alias("row_number"),
        (F.col("at") % shards).cast("int").alias("shard"),
        F.expr(f"at div {int(shards)}").alias("slot"),
    )


def write(
    docs: DataFrame, path: str, *, order_by: Sequence[str], shards: int = SHARDS, seed: int = SEED
) -> None:
    """Parquet files per shard, rows in the order of their slots within each file.

    A shard may be several files, each a range of slots, so no shard has to fit one task.
    """
    placed = assign(docs, order_by=order_by, shards=shards, seed=seed)
    ranges = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranges.write.partitionBy("shard").parquet(path)


def sizes(text: str) -> list[Column]:
    """``size`` (bytes of the text, none if null, and 8) and ``text_crc32``, 0 for null."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return [
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    ]
