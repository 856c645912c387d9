"""Alignment of two tokenizers over the same bytes, by a galloping intersection of token ends.

Documents of a block are laid end to end. Both tokenizers spell the same bytes, so each gives
an ascending list of token ends. The shorter list drives: every end is sought in the longer
one from where an end before it was found, in steps that double and then by halving. Ends in
both lists cut the tokens into groups; differences of the ranks are the ranges of tokens that
overlap, hence the links.

Id pairs are counted corpus-wide without moving documents for it: a block sends each distinct
pair of ids once, with the number of its documents that hold it linked, the counts are added
up, and the block is answered once per pair. So a frequent pair is at most one row a block.
Blocks are bounded in bytes of text; a longer text is a block of its own.

Defined results: a text that is null or empty, or that one of the tokenizers does not spell
byte by byte, has no tokens (zeros, no groups); rows that repeat an id or a text are documents
of their own; further columns are not read. A text is encoded whole, in one task, whose memory
grows with it.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callgauge.llm.common import stored

BLOCK_BYTES = 8 << 20
MARK = "▁"
_SPACE = " "
# a longer stretch without a word boundary goes to the library whose merging is not quadratic
_LONG_RUN = 1000
# fixed value: how byte-level BPE files with their usual setting split a text before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Byte-level BPE from a tokenizers file; ids of ordinary text, special strings included."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return ByteBpe, (self.data,)

    @cached_property
    def file(self) -> dict:
        return json.loads(self.data)

    @cached_property
    def special(self) -> set[int]:
        return {t["id"] for t in self.file["added_tokens"] if t["special"]}

    @cached_property
    def spelled(self) -> list[bytes | None]:
        """The bytes of every id."""
        letters = _byte_letters()
        out: list[bytes | None] = [None] * (1 + max(self.file["model"]["vocab"].values()))
        for text, i in self.file["model"]["vocab"].items():
            out[i] = text.encode() if i in self.special else bytes(letters[c] for c in text)
        return out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.data.decode())
        found.encode_special_tokens = True
        return found

    @cached_property
    def quick(self):
        """The same ids from tiktoken, if the file is plain enough for that: ids in merge order."""
        split, model = self.file["pre_tokenizer"] or {}, self.file["model"]
        ranks = {t: i for i, t in enumerate(self.spelled) if t is not None and i not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(ranks) - len(pairs)
        plain = (
            self.file["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and all(model["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(pairs))
        )
        if not plain:
            return None
        import tiktoken

        return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        words = text.split()
        longest = max(map(len, words), default=0)
        blank = len(text) - sum(map(len, words)) - len(words)
        if self.quick and longest < _LONG_RUN and blank < _LONG_RUN:
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceModel:
    """A SentencePiece model; ids and the bytes they stand for."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return PieceModel, (self.data,)

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    @cached_property
    def spelled(self) -> list[bytes]:
        model = self.library
        out = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else None
            out.append(piece.replace(MARK, _SPACE).encode() if raw is None else raw)
        return out

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Per element of ``short`` the first index in ``long`` with a value no smaller.

    Both ascend. Elements are taken in halving strides, so that all of one stride search side
    by side, each from the place of a neighbour to its left.
    """
    n, m = len(short), len(long)
    rank = np.zeros(n, dtype=np.int64)
    stride = 1 << max(n - 1, 0).bit_length()
    while stride and m:
        at = np.arange(stride - 1, n, 2 * stride)
        wanted = short[at]
        low = rank[at - stride]
        low[at < stride] = 0
        high = low.copy()
        far = np.flatnonzero(long[np.minimum(high, m - 1)] < wanted)
        step = 1
        while len(far):  # everything up to low - 1 is smaller
            low[far] = high[far] + 1
            high[far] = np.minimum(high[far] + step, m)
            inside = far[high[far] < m]
            far = inside[long[high[inside]] < wanted[inside]]
            step *= 2
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            less = long[middle] < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        rank[at] = high
        stride >>= 1
    return rank


def _cut(ends_a: np.ndarray, ends_b: np.ndarray):
    """Links as (indexes in A, indexes in B), and which tokens of A and of B end a group."""
    swapped = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    rank = gallop(short, long)
    common = long[rank] == short if len(short) else np.zeros(0, dtype=bool)
    first = np.zeros(len(short), dtype=np.int64)
    first[1:] = rank[:-1] + common[:-1]
    width = rank - first + 1
    from_short = np.repeat(np.arange(len(short)), width)
    from_long = np.arange(len(from_short)) - np.repeat(np.cumsum(width) - width - first, width)
    shared = np.zeros(len(long), dtype=bool)
    shared[rank[common]] = True
    if swapped:
        return from_long, from_short, shared, common
    return from_short, from_long, common, shared


def _ends(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids], dtype=np.int64)


class Aligner:
    """Two tokenizers; aligns the documents of one block."""

    def __init__(self, a: ByteBpe, b: PieceModel):
        self.a, self.b = a, b

    def __reduce__(self):
        return Aligner, (self.a, self.b)

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t or b"") for t in x.spelled]) for x in (self.a, self.b))

    @cached_property
    def written(self) -> list[bytes]:
        """Ids as decimals: of A before a comma and a bar, of B before a comma and a semicolon."""
        a, b = len(self.a.spelled), len(self.b.spelled)
        return [
            b"%d%s" % (i, mark) for n, marks in ((a, b",|"), (b, b",;")) for i in range(n)
            for mark in (marks[:1], marks[1:])
        ]

    def ids(self, text: str | None) -> tuple[array, array]:
        """Both encodings; empty ones if one does not spell the text."""
        if text:
            whole = _SPACE + text
            data = whole.encode()
            a = self.a.encode(whole)
            if b"".join(map(self.a.spelled.__getitem__, a)) == data:
                b = self.b.encode(text)
                if b"".join(map(self.b.spelled.__getitem__, b)) == data:
                    return array("i", a), array("i", b)
        return array("i"), array("i")

    def block(self, texts: list[str | None]) -> dict:
        """Per document numbers and links, and the block's distinct id pairs."""
        both = [self.ids(t) for t in texts]
        a, b = (
            np.frombuffer(b"".join(x[k].tobytes() for x in both), dtype=np.int32) for k in (0, 1)
        )
        n_a, n_b = (np.array([len(x[k]) for x in both], dtype=np.int64) for k in (0, 1))
        del both
        off_a, off_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        link_a, link_b, cut_a, cut_b = _cut(_ends(a, self.lengths[0]), _ends(b, self.lengths[1]))
        cuts = np.concatenate([[0], np.cumsum(cut_a)])
        n_groups = np.diff(cuts[off_a])
        digests = self._groups(a, b, cut_a, cut_b, off_a + off_b)
        # pairs of ids, and per document the distinct ones and how often they are linked
        pairs = a[link_a].astype(np.int64) << 32 | b[link_b]
        doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
        del link_a, link_b
        n_links = np.bincount(doc, minlength=len(texts))
        found, at = np.unique(pairs, return_inverse=True)
        del pairs
        per_doc, times = np.unique(doc * max(len(found), 1) + at, return_counts=True)
        del doc, at
        owner, place = np.divmod(per_doc, max(len(found), 1))
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_links,
            "groups_sha256": digests,
            "bounds": np.searchsorted(owner, np.arange(len(texts) + 1)),
            "place": place,
            "times": times,
            "pairs": found,
            "docs": np.bincount(place, minlength=len(found)),
        }

    def _groups(self, a, b, cut_a, cut_b, bounds) -> list[str]:
        """Digest of each document's groups written out."""
        after_a, after_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        before_b = np.concatenate([[0], after_b])
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = 2 * a + cut_a
        codes[np.arange(len(b)) + after_a[group_b]] = 2 * (b + len(self.a.spelled)) + cut_b
        words, out = self.written, []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if low == high:
                out.append("")
                continue
            text = b"".join(map(words.__getitem__, codes[low:high].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest())
        return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds, type=pa.int32()), pa.array(values, type=pa.int32())
    )


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows regrouped to blocks of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(1)]
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if sum(t.num_rows for t in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _align(shared, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_blocks(batches, most)):
            got = shared.value.block(rows.column(1).to_pylist())
            first = np.concatenate([[0], np.full(rows.num_rows, len(got["pairs"]))])
            missing = pa.array(np.arange(rows.num_rows) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).combine_chunks(),
                    pa.array(np.full(rows.num_rows, task << 32 | number)),
                    *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(got["groups_sha256"], type=pa.string()),
                    _lists(got["place"], got["bounds"]),
                    _lists(got["times"], got["bounds"]),
                    pa.ListArray.from_arrays(
                        pa.array(first, type=pa.int32()), pa.array(got["pairs"]), mask=missing
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(first, type=pa.int32()),
                        pa.array(got["docs"], type=pa.int32()),
                        mask=missing,
                    ),
                ],
                schema=schema,
            )

    return run


def _answer(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block."""
    counts = np.zeros(answers.num_rows, dtype=np.int64)
    best = np.zeros(answers.num_rows, dtype=np.int64)
    at = answers["at"].to_numpy()
    counts[at] = answers["n"].to_numpy()
    best[at] = answers["best"].to_numpy()
    place, times = (
        c.flatten().to_numpy().astype(np.int64)
        for c in (rows["place"].combine_chunks(), rows["times"].combine_chunks())
    )
    ends = np.cumsum([0, *(len(x) for x in rows["place"])])

    def summed(values: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(values[place] * times)])[ends]))

    kept = rows.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    return (
        kept.append_column("n_best", summed(best))
        .append_column("count_sum", summed(counts))
        .append_column("groups_sha256", rows["groups_sha256"])
    )


def align(
    docs: DataFrame,
    a: ByteBpe,
    b: PieceModel,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, id pairs).

    Documents: id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is among the most
    frequent of its A id), count_sum (their pairs' counts added up), groups_sha256. Id pairs:
    a, b, n (documents that hold the pair linked), best.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Aligner(a, b))
    kind = docs.schema[id_col].dataType
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema(
        [
            ("id", to_arrow_type(kind)),
            ("block", pa.int64()),
            *((c, pa.int64()) for c in numbers),
            ("groups_sha256", pa.string()),
            ("place", pa.list_(pa.int32())),
            ("times", pa.list_(pa.int32())),
            ("pairs", pa.list_(pa.int64())),
            ("docs", pa.list_(pa.int32())),
        ]
    )
    id_ddl = f"id {kind.simpleString()}"
    aligned = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _align(shared, block_bytes, schema),
            f"{id_ddl}, block long, {', '.join(f'{c} long' for c in numbers)}, "
            "groups_sha256 string, place array<int>, times array<int>, "
            "pairs array<long>, docs array<int>",
        ),
        "aligned",
    )
    asked = (
        aligned.filter("pairs IS NOT NULL")
        .select(
            F.col("block").alias("asker"),
            F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "asked"),
        )
        .select("asker", "at", F.col("asked.pairs").alias("pair"), F.col("asked.docs").alias("docs"))
    )
    counts = stored(
        asked.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn(
            "a", F.shiftright("pair", 32).cast("int")
        ),
        "pair-counts",
    )
    # an id of A has at most one row per id of B
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    table = stored(
        counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
        "pairs",
    )
    answers = asked.join(table, "pair").select(
        "asker", "at", "n", F.col("best").cast("int").alias("best")
    )
    found = (
        aligned.drop("pairs", "docs")
        .groupBy("block")
        .cogroup(answers.groupBy("asker"))
        .applyInArrow(
            _answer,
            f"{id_ddl}, {', '.join(f'{c} long' for c in numbers)}, "
            "n_best long, count_sum long, groups_sha256 string",
        )
    )
    pairs = table.select(
        F.shiftright("pair", 32).cast("int").alias("a"),
        F.expr("pair & 4294967295").cast("int").alias("b"),
        "n",
        "best",
    )
    return found, pairs
