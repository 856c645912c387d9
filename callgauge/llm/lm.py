"""Stupid-backoff scores of every document against the rest of the corpus.

Documents are dealt over blocks by hash. A block explodes its documents into n-grams of all
orders, as 64-bit hashes, and sends each distinct one with its count to the hash range that
holds its part of the count tables. The ranges add up the counts of all blocks and answer
every block with the totals of what it asked for, in the order it asked. The block joins
the totals to its n-grams and sums the scores per document. An n-gram is sent once per block
however often it occurs, so frequent n-grams make no hot key, and all that a task holds is
one block or one hash range.

The score of a word w after a context c is count(c w) / count(c) if the corpus without the
document holds c w, else ``backoff`` times the score after the next shorter context. The
empty n-gram counts the words of the corpus; a word that no other document has counts once.

Words are split at ASCII white space after lower-casing A-Z. Defined results: a document
without words has n_words 0, log_score 0 and a null mean; repeated rows are documents of
their own; a corpus of one document backs off to its unseen words throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import utf8

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20  # text per block; a hash range receives about as much
_NONE = np.uint64(0)  # hash of the empty n-gram


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and per order the hash of the n-gram that ends at each word (0: none)."""
    hashes = _WordHashes()
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    one = np.fromiter((hashes[w] for ws in words for w in ws), dtype=np.uint64, count=total)
    one |= np.uint64(1)  # leaves 0 to the empty n-gram
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    orders = [one]
    for k in range(2, order + 1):
        longer = np.zeros(total, dtype=np.uint64)
        mixed = orders[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        longer[1:] = mixed | np.uint64(1)
        longer[place < k - 1] = _NONE
        orders.append(longer)
    return sizes, orders


def _asked(orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, ascending, and their counts; first the empty one."""
    found, counts = np.unique(np.concatenate(orders), return_counts=True)
    if len(found) and found[0] == _NONE:
        found, counts = found[1:], counts[1:]
    words = len(orders[0])
    return np.concatenate([[_NONE], found]), np.concatenate([[words], counts])


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes, which the shuffle's compression makes small."""
    rows = np.ascontiguousarray(values.astype(kind)).view(np.uint8)
    return rows.reshape(len(values), -1).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(rows).view(kind).ravel()


def _slices(found: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(hash range, first, end) of the ranges that ascending hashes fall into."""
    parts = found // np.uint64((1 << 64) // ranges + 1) if ranges > 1 else found & np.uint64(0)
    numbers, first = np.unique(parts.astype(np.int64), return_index=True)
    return list(zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(found)], strict=True))


def _request(order: int, ranges: int):
    def run(block: pa.Table) -> pa.Table:
        _, orders = _grams(block["text"].to_pylist(), order)
        found, counts = _asked(orders)
        parts = _slices(found, ranges)
        return pa.table(
            {
                "part": pa.array([i for i, _, _ in parts], type=pa.int64()),
                "block": pa.array([block["block"][0].as_py()] * len(parts), type=pa.int64()),
                "grams": pa.array(
                    [
                        _planes(np.diff(found[a:b], prepend=np.uint64(0)), "<u8")
                        for _, a, b in parts
                    ],
                    type=pa.binary(),
                ),
                "counts": pa.array([_planes(counts[a:b], "<u8") for _, a, b in parts]),
            }
        )

    return run


def _total(requests: pa.Table) -> pa.Table:
    """The counts of one hash range over all blocks, answered block by block."""
    grams = [
        np.cumsum(_numbers(g, "<u8"), dtype=np.uint64) for g in requests["grams"].to_pylist()
    ]
    counts = np.concatenate([_numbers(c, "<u8") for c in requests["counts"].to_pylist()])
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    # sums of counts are whole numbers far below 2**53
    totals = np.bincount(at, weights=counts.astype(np.float64)).astype("<u8")[at]
    ends = np.cumsum([len(g) for g in grams])
    return pa.table(
        {
            "block": requests["block"],
            "part": requests["part"],
            "totals": pa.array([_planes(t, "<u8") for t in np.split(totals, ends[:-1])]),
        }
    )


def _score(order: int, backoff: float, id_type: pa.DataType):
    schema = pa.schema(
        [
            ("id", id_type),
            ("n_words", pa.int64()),
            ("n_backoff", pa.int64()),
            ("log_score", pa.float64()),
        ]
    )

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        sizes, orders = _grams(block["text"].to_pylist(), order)
        found, _ = _asked(orders)
        parts = sorted(
            zip(answers["part"].to_pylist(), answers["totals"].to_pylist(), strict=True)
        )
        totals = np.concatenate([_numbers(t, "<u8") for _, t in parts]).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rest = []  # per order, how often the other documents hold the n-gram at each word
        for grams in orders:
            at = np.searchsorted(found, grams)
            _, inverse, own = np.unique(
                doc * len(found) + at, return_inverse=True, return_counts=True
            )
            rest.append(np.where(grams == _NONE, 0, totals[at] - own[inverse]))
        others = np.maximum(totals[0] - sizes, 1)[doc]
        scores = np.log(np.maximum(rest[0], 1) / others)
        backed = np.zeros(len(doc), dtype=bool)
        for k in range(1, order):
            inside = orders[k] != _NONE
            context = np.concatenate([[1], rest[k - 1][:-1]]) if len(doc) else rest[k - 1]
            seen = inside & (rest[k] > 0)
            ratio = np.log(np.maximum(rest[k], 1) / np.maximum(context, 1))
            lower = np.where(inside, scores + math.log(backoff), scores)
            scores = np.where(seen, ratio, lower)
            backed = inside & ~seen
        return pa.table(
            {
                "id": block["id"].cast(id_type),
                "n_words": pa.array(sizes),
                "n_backoff": pa.array(
                    np.bincount(doc, weights=backed, minlength=len(sizes)).astype(np.int64)
                ),
                "log_score": pa.array(np.bincount(doc, weights=scores, minlength=len(sizes))),
            },
            schema=schema,
        )

    return run


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_backoff, log_score, mean_log_score."""
    size = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).select(
        "id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long").alias("block")
    )
    answers = (
        rows.groupBy("block")
        .applyInArrow(_request(order, blocks), "part long, block long, grams binary, counts binary")
        .groupBy("part")
        .applyInArrow(_total, "block long, part long, totals binary")
    )
    kind = docs.schema[id_col].dataType
    id_type = pa.string() if kind.typeName() == "string" else pa.int64()
    scored = (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _score(order, backoff, id_type),
            f"id {'string' if kind.typeName() == 'string' else 'long'}, "
            "n_words long, n_backoff long, log_score double",
        )
    )
    return scored.withColumn(
        "mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    )
