"""Exact deduplication in two passes over a Bloom filter.

The first pass sets bits: a task sends, per segment of the filter, which bits its rows set
once and which more than once; segments are merged in parallel. The second pass asks the
merged filter which rows may repeat: all bits of such a row were set at least twice. Only
those rows are shuffled, compared by SHA-256; the others pass straight through.

The filter is sized by the number of rows up to ``max_bits``, a fixed bound on what is
broadcast. Beyond the bound more rows take the shuffled way; the result is the same.

Texts are equal if they are after lower-casing A-Z only. Defined results: null counts as
empty; among repeated rows with the largest id of a group one stays (``keep`` drops the
rest); a null id only stays if its whole group has no id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import stored, utf8

MAX_BITS = 1 << 28  # 32 MB
BITS_PER_ROW = 16
PROBES = 3
_SEGMENT = 1 << 16  # bits of one filter segment


@F.arrow_udf(T.BinaryType())
def _text_sha256(texts: pa.Array) -> pa.Array:
    # bytes.lower() changes A-Z only
    return pa.array(
        [hashlib.sha256(t.as_buffer().to_pybytes().lower()).digest() for t in texts],
        type=pa.binary(),
    )


def text_sha256(text: str | Column) -> Column:
    """SHA-256 of a text after lower-casing A-Z, as 32 bytes."""
    return _text_sha256(utf8(text))


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two with ``BITS_PER_ROW`` bits a row, within the bounds."""
    wanted = max(_SEGMENT, rows * BITS_PER_ROW)
    return min(max_bits, 1 << (wanted - 1).bit_length())


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """PROBES positions per digest, from the digest's own bytes."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return (flat[:, :PROBES] & np.uint64(bits - 1)).astype(np.int64)


def _set_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _positions(batch.column(0), bits)
            # a row may hit one bit twice; that is no repetition
            at.sort(axis=1)
            fresh = np.ones(at.shape, dtype=bool)
            fresh[:, 1:] = at[:, 1:] != at[:, :-1]
            places, n = np.unique(at[fresh], return_counts=True)
            segments, first = np.unique(places // _SEGMENT, return_index=True)
            low = (places % _SEGMENT).astype("<u2")
            ends = [*first[1:], len(places)]
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(segments),
                    "once": pa.array(
                        [
                            low[a:b][n[a:b] == 1].tobytes()
                            for a, b in zip(first, ends, strict=True)
                        ],
                        type=pa.binary(),
                    ),
                    "twice": pa.array(
                        [low[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, ends, strict=True)],
                        type=pa.binary(),
                    ),
                }
            )

    return run


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits set at least twice, of the segments that this task holds."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment not in seen:
                seen[segment] = (np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool))
            some, more = seen[segment]
            one, two = np.frombuffer(once, "<u2"), np.frombuffer(twice, "<u2")
            more[one[some[one]]] = True
            more[two] = True
            some[one] = True
            some[two] = True
    for segment, (_, more) in seen.items():
        if more.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([segment], type=pa.int64()),
                    "bits": pa.array([np.packbits(more).tobytes()], type=pa.binary()),
                }
            )


def repeated_filter(digests: DataFrame, bits: int) -> np.ndarray:
    """The bits that at least two rows set; ``digests`` has one binary column."""
    sent = digests.mapInArrow(_set_bits(bits), "segment long, once binary, twice binary")
    parts = max(1, min(bits // _SEGMENT, 64))
    merged = sent.repartition(parts, "segment").mapInArrow(
        _merge_bits, "segment long, bits binary"
    )
    found = np.zeros(bits // 8, dtype=np.uint8)
    size = _SEGMENT // 8
    for row in merged.toLocalIterator():  # at most bits / 8 bytes in all
        found[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return found


def maybe_repeated(df: DataFrame, sha: str, max_bits: int = MAX_BITS) -> Column:
    """Column: may the row's digest (a binary column of ``df``) occur in another row?

    Never false for a digest that does.
    """
    spark = df.sparkSession
    bits = filter_bits(df.select(F.lit(1)).count(), max_bits)
    shared = spark.sparkContext.broadcast(repeated_filter(df.select(sha), bits))

    @F.arrow_udf(T.BooleanType())
    def test(digests: pa.Array) -> pa.Array:
        if not len(digests):
            return pa.array([], type=pa.bool_())
        at = _positions(digests, bits)
        found = (shared.value[at >> 3] >> (7 - (at & 7))) & 1
        return pa.array(found.all(axis=1))

    return test(F.col(sha))


def groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = stored(
        docs.select(F.col(id_col).alias("id"), text_sha256(text_col).alias("sha")), "digests"
    )
    tested = rows.withColumn("maybe", maybe_repeated(rows, "sha", max_bits))
    alone = tested.filter("NOT maybe").select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    doubtful = tested.filter("maybe").select("id", "sha")
    sizes = stored(
        doubtful.groupBy("sha").agg(
            F.max("id").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "digest-groups",
    )
    found = alone.unionByName(
        doubtful.join(sizes, "sha").select("id", "sha", "keep_id", "group_size")
    )
    return found.select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows that stay, with all their columns; rows without a possible copy never move."""
    held, sha, maybe = "__row", "__sha", "__maybe"
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held),
        text_sha256(text_col).alias(sha),
    )
    tested = rows.withColumn(maybe, maybe_repeated(rows, sha, max_bits))
    id_of = F.col(held)[id_col]
    doubtful = tested.filter(maybe).select(held, sha)
    best = stored(doubtful.groupBy(sha).agg(F.max(id_of).alias("__keep")), "digest-groups")
    # rows that repeat the kept id are equal up to their other columns: one of them stays
    stay = (
        doubtful.join(best, sha)
        .filter(id_of.eqNullSafe(F.col("__keep")))
        .groupBy(sha)
        .agg(F.min(held).alias(held))
    )
    return (
        tested.filter(f"NOT {maybe}").select(held).unionByName(stay.select(held)).select(f"{held}.*")
    )
