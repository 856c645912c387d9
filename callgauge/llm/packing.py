"""Best-fit packing into bins of several permitted sizes.

Documents become pieces no longer than the largest size. Pieces are dealt over shards, as
many as their number asks for, and every shard is packed on its own: largest piece first,
into the open bin, of whichever size, that it leaves the least room in. A piece that fits
nowhere opens the bin size with the least cost per token that the shard can still put into
it, so large bins are opened while there is enough to fill them and smaller ones at the end.
Where every size divides the next, that volume is what remains, since a larger bin then holds
whatever several smaller ones would; else it is what the largest remaining pieces that fit
would fill, and the cost that of the size the bin would shrink to.
Finally each bin shrinks to the least permitted size that holds its contents.

Only lengths are shuffled. Defined results: a null or empty text is one row of length 0
without a bin; repeated rows are separate documents, told apart by ``copy``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (256, 512, 1024, 2048)
BIN_COST = 16.0  # tokens that opening a bin costs beside its size
SHARD = 20_000  # pieces packed together


def words(text: str | Column) -> Column:
    """Length of a text in words, the unit the registered query packs by."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _cheapest(
    sizes: list[int], need: int, kinds: list[int], left_of: Counter, bin_cost: float
) -> int:
    """The size of least cost per token if the largest remaining pieces that fit fill it."""

    def cost(size: int) -> tuple[float, int]:
        room, at = size, bisect_left(kinds, need) + 1
        while at and room:
            at = bisect_right(kinds, room, 0, at) - 1
            if at < 0:
                break
            room -= kinds[at] * min(left_of[kinds[at]], room // kinds[at])
        filled = size - room
        return (bin_cost + min(s for s in sizes if s >= filled)) / filled, size

    return min(sizes, key=cost)


def pack_shard(
    lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the size of each bin after shrinking."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    rooms: list[int] = []  # the distinct rooms left in open bins, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    volume = int(lengths.sum())
    ladder = sorted(sizes)
    nested = all(b % a == 0 for a, b in zip(ladder, ladder[1:], strict=False))
    left_of = Counter(lengths.tolist())  # pieces without a bin yet, by length
    kinds = sorted(left_of)
    for i in order:
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            wanted = [s for s in sizes if s >= need]
            if nested:
                room = min(wanted, key=lambda s: ((bin_cost + s) / min(s, volume), s))
            else:
                room = _cheapest(wanted, need, kinds, left_of, bin_cost)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        volume -= need
        left_of[need] -= 1
        if not left_of[need]:
            kinds.pop()  # the largest that remained
        if room > need:
            left = room - need
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    shrunk = [min(s for s in sizes if s >= u) for u in used]
    return bins, offsets, shrunk


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    length: Column,
    sizes: tuple[int, ...] = SIZES,
    bin_cost: float = BIN_COST,
    shard: int = SHARD,
) -> DataFrame:
    """One row per piece: id, copy, piece, start, length, bin, bin_size, offset.

    ``start`` is the piece's place in its document and ``offset`` that in its bin, both in
    the unit of ``length``.
    """
    sizes = tuple(sorted(set(sizes)))
    most = sizes[-1]
    lengths = (
        docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n"))
        .groupBy("id", "n")
        .agg(F.count("*").alias("copies"))
        .select("id", "n", F.posexplode(F.sequence(F.lit(1), F.col("copies"))))
        .select("id", F.col("pos").cast("long").alias("copy"), "n")
    )
    pieces = lengths.select(
        "id",
        "copy",
        "n",
        F.posexplode(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)))
        ).alias("piece", "_"),
    ).select(
        "id",
        "copy",
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * most).cast("long").alias("start"),
        F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("length"),
    )
    total = docs.select(
        F.sum(F.greatest(F.ceil(length.cast("long") / most), F.lit(1))).alias("n")
    ).first()["n"]
    shards = max(1, math.ceil((total or 0) / shard))
    dealt = pieces.withColumn(
        "shard",
        F.when(
            F.col("length") > 0, F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(shards))
        ).cast("long"),
    )

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(
            [("length", "descending")] + [(c, "ascending") for c in ("id", "copy", "piece")]
        )
        bins, offsets, shrunk = pack_shard(rows["length"].to_numpy(), sizes, bin_cost)
        shard_name = rows["shard"][0].as_py()
        columns = {c: rows[c] for c in ("id", "copy", "piece", "start", "length")}
        columns["bin"] = pa.array([f"{shard_name}-{b}" for b in bins])
        columns["bin_size"] = pa.array(np.array(shrunk, dtype=np.int64)[bins])
        columns["offset"] = pa.array(offsets)
        return pa.table(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, copy long, piece long, start long, length long, "
        "bin string, bin_size long, offset long"
    )
    packed = dealt.filter("length > 0").groupBy("shard").applyInArrow(fill, schema)
    empty = dealt.filter("length = 0").select(
        "id",
        "copy",
        "piece",
        "start",
        "length",
        F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("long").alias("bin_size"),
        F.lit(None).cast("long").alias("offset"),
    )
    return packed.unionByName(empty)
