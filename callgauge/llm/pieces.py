"""SentencePiece encoding and decoding over a shared prefix trie.

Marked texts (spaces are marks) are cut into words where no piece holds both neighbours, since
no piece can then lie across; a batch is cut at once, on arrays. Its distinct words that are
new are sorted, which lays their trie out depth-first. A forward pass walks down each branch
and keeps one state per character on a stack; the next word goes on from the prefix it shares
with the one before, so common prefixes are scored once.

The state depends on the model's kind. For unigram models it is Viterbi's: the best score of
the prefix and the piece that ends it. For BPE models, whose result is no sum of scores, it
is the last piece of the prefix's encoding: a piece may follow another exactly if BPE turns
their two texts into these two pieces, and one sequence only has all its neighbours so.

The model file is a parameter and is sent to the executors as bytes. Words never cross a
space mark, which is checked against the vocabulary. Long ones are encoded on their own and
not remembered. What a worker remembers is bounded in bytes.

Defined results: a null text has null ids, an empty one has none; characters without a piece
become byte pieces (or the unknown piece, if the model has no bytes); texts and words of any
length are encoded whole, with some 16 bytes of state per character of a word.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNIGRAM, BPE = 1, 2
# piece types of the model format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PAIRS = 400_000  # pairs of pieces that a worker remembers
_CACHE = 96 << 20  # bytes of words and their ids that a worker remembers
_OVERHEAD = 200  # bytes that a remembered word takes besides
_ALONE = 1024  # characters from which on a word is encoded on its own, and not remembered
_CHUNK = 1 << 22  # characters encoded together
_UNKNOWN_PENALTY = 10.0
_SLOTS = 64  # slots for each pair of neighbours
_TAKEN = 1 << 16  # words whose ids are laid end to end at once


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, read by Spark so that any file system will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Model:
    """Pieces and scores of a SentencePiece model."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are encoded")
        if proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("models that normalise characters are not encoded")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.types = [p.type for p in proto.pieces]
        self.texts = [p.piece for p in proto.pieces]
        usable = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        self.ids = {p.piece: i for i, p in usable}
        self.scores = {p.piece: p.score for _, p in usable}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if self.types[i] == BYTE}
        self.longest = max(map(len, self.ids))
        self.floor = min(self.scores.values()) - _UNKNOWN_PENALTY
        self.across = any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        # words as marks alone bound them
        self.word = re.compile("(?s).+" if self.across else f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")
        self.follows: dict[int, bool] = {}
        # the state before a word: no piece, no start, and what its kind needs besides
        self.root = (None, 0, self.base(None) if self.kind == BPE else 0.0)

    @cached_property
    def tails(self) -> dict[str, int | None]:
        """All ends of pieces, and which of them are pieces; another text ends no piece."""
        return dict.fromkeys(t[i:] for t in self.ids for i in range(len(t))) | self.ids

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours merge until none can."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def spelled(self, piece: int) -> str:
        """The text of a piece, or of a character without one (minus one, minus its code point)."""
        return self.texts[piece] if piece >= 0 else chr(-1 - piece)

    @staticmethod
    def base(before: int | None) -> int:
        """With the next piece added, one number for the two; each is within 2**21 of zero."""
        return ((0 if before is None else before + (1 << 22)) << 23) + (1 << 22)

    def may_follow(self, before: int | None, piece: int) -> bool:
        """Does BPE leave the two pieces as they are, side by side (or the second alone)?"""
        if len(self.follows) > _PAIRS:
            self.follows.clear()
        wanted = [self.spelled(p) for p in (before, piece) if p is not None]
        found = self.follows[self.base(before) + piece] = self.merge("".join(wanted)) == wanted
        return found

    def step_bpe(self, word: str, end: int, states: list) -> tuple[int, int, int]:
        """Last piece of the encoding of word[:end], where it starts, the piece's base."""
        tails, follows = self.tails, self.follows
        start = end - 1
        piece = self.ids.get(word[start])
        if piece is None:
            piece = -1 - ord(word[start])
        while True:
            if piece is not None:
                state = states[start]
                fits = follows.get(state[2] + piece)
                if fits or (fits is None and self.may_follow(state[0], piece)):
                    # as ``base``, which would take longer to call
                    return piece, start, (piece + (1 << 22) << 23) + (1 << 22)
            start -= 1  # every prefix has an encoding, so this ends, at an end of a piece
            piece = tails[word[start:end]]

    def step_unigram(self, word: str, end: int, states: list) -> tuple[int, int, float]:
        """Last piece of the best segmentation of word[:end], where it starts, the score."""
        best = (-1 - ord(word[end - 1]), end - 1, states[end - 1][2] + self.floor)
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            text = word[start:end]
            if end - start > 1 and text not in self.tails:
                break
            piece = self.ids.get(text)
            if piece is not None and (total := states[start][2] + self.scores[text]) > best[2]:
                best = (piece, start, total)
        return best

    @cached_property
    def neighbours(self) -> set[str]:
        """All pairs of characters that stand side by side in a piece."""
        return {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}

    @cached_property
    def beside(self) -> np.ndarray:
        """Neighbours by slot; the few other pairs that share one are not cut, though they could."""
        bits = (_SLOTS * len(self.neighbours)).bit_length()
        found = np.zeros(1 << bits, dtype=bool)
        pairs = np.frombuffer("".join(self.neighbours).encode("utf-32-le"), np.uint32)
        found[_slots(pairs[0::2], pairs[1::2], bits)] = True
        return found

    def cut_at(self, points: np.ndarray) -> np.ndarray:
        """Where a text, given as code points, falls into words that are encoded as within it."""
        beside = self.beside
        bits = len(beside).bit_length() - 1
        apart = np.ones(len(points), dtype=bool)
        np.logical_not(beside[_slots(points[:-1], points[1:], bits)], out=apart[1:])
        if not self.across:  # words end at marks, whatever slots these pairs share
            marks = points == ord(MARK)
            apart[1:] |= marks[1:] & ~marks[:-1]
        return apart

    def words(self, text: str) -> list[str]:
        return self.cut(self.marked(text))

    def cut(self, marked: str) -> list[str]:
        at = np.flatnonzero(self.cut_at(np.frombuffer(marked.encode("utf-32-le"), np.uint32)))
        return [marked[a:b] for a, b in pairwise([*at.tolist(), len(marked)])]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, visited in the depth-first order of their trie."""
        step = self.step_bpe if self.kind == BPE else self.step_unigram
        states: list = [self.root]
        before, out = "", {}
        for word in sorted(words):
            if len(word) >= _ALONE:
                out[word] = self.encode_long(word)
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            pieces, end = [], len(word)
            while end > 0:
                pieces.append(states[end][0])
                end = states[end][1]
            pieces.reverse()
            out[word] = self.spelt_out(pieces)
            before = word
        return out

    def spelt_out(self, pieces: list[int]) -> list[int]:
        """Ids, once characters without a piece are given theirs."""
        if min(pieces) >= 0:
            return pieces
        return [i for p in pieces for i in ([p] if p >= 0 else self.bare(chr(-1 - p)))]

    def encode_long(self, word: str) -> list[int]:
        """Ids of one word, with two numbers of state kept per character."""
        step = self.step_bpe if self.kind == BPE else self.step_unigram
        near: deque = deque([self.root], maxlen=self.longest + 1)  # states a step looks at
        pieces, starts = array("i"), array("q")
        for end in range(1, len(word) + 1):
            first = max(0, end - self.longest)  # of the characters that the next piece may hold
            low = end - len(near)
            near.append(_moved(step(word[first:end], end - first, _Near(near, first - low)), first))
            pieces.append(near[-1][0])
            starts.append(near[-1][1])
        found, end = [], len(word)
        while end > 0:
            found.append(pieces[end - 1])
            end = starts[end - 1]
        found.reverse()
        return self.spelt_out(found)

    def bare(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_batch(self, texts: list[str | None], known: Words) -> list[bytes | None]:
        """Ids of texts as 32-bit numbers; ``known`` keeps the words of earlier batches."""
        marked = ["" if t is None else self.marked(t) for t in texts]
        starts = np.cumsum([0, *map(len, marked)])
        text = "".join(marked)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cut = self.cut_at(points)
        cut[starts[starts < len(points)]] = True
        at = np.flatnonzero(cut)
        words = _slices(text, points, at).dictionary_encode()
        places = words.indices.to_numpy()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, ends = _spread(self.known_ids(distinct, known), places)
        bounds = (4 * ends[np.searchsorted(at, starts)]).tolist()
        return [
            None if t is None else ids[a:b]
            for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)
        ]

    def known_ids(self, words: list[str], known: Words) -> list[bytes]:
        """The ids of distinct words; those of new ones are remembered."""
        ids = known.ids
        fresh = [w for w in words if w not in ids]
        for word, found in self.encode_words(fresh).items():
            ids[word] = array("i", found).tobytes()
        out = list(map(ids.__getitem__, words))
        known.bound(fresh)
        return out

    @cached_property
    def plain(self) -> tuple[list[str], np.ndarray]:
        """What each piece reads as on its own, and which need their neighbours."""
        reads, odd = [], np.zeros(len(self.texts), dtype=bool)
        for i, (text, kind) in enumerate(zip(self.texts, self.types, strict=True)):
            value = int(text[3:5], 16) if kind == BYTE else 0
            odd[i] = kind in (CONTROL, UNKNOWN) or value > 0x7F
            reads.append(chr(value) if kind == BYTE else text.replace(MARK, " "))
        return reads, odd

    def decode(self, ids: np.ndarray | list[int]) -> str:
        reads, odd = self.plain
        ids = np.asarray(ids, dtype=np.int64)
        if not odd[ids].any():
            text = "".join(map(reads.__getitem__, ids.tolist()))
            return text[1:] if self.prefix and text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids.tolist():
            kind = self.types[i]
            if kind == BYTE:
                held.append(int(self.texts[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(reads[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A slot of so many bits for each pair of code points."""
    mixed = left * np.uint32(0x9E3779B1)
    mixed ^= right * np.uint32(0x85EBCA6B)
    mixed >>= np.uint32(32 - bits)
    return mixed


def _slices(text: str, points: np.ndarray, at: np.ndarray) -> pa.Array:
    """A text, whose code points are given, as strings that start at some of them."""
    sizes = np.ones(len(points), dtype=np.int8)
    for more in (0x7F, 0x7FF, 0xFFFF):
        sizes += points > more
    offsets = np.append(0, np.cumsum(np.add.reduceat(sizes, at, dtype=np.int64)))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())]
    return pa.Array.from_buffers(pa.large_string(), len(at), buffers)


def _spread(found: list[bytes], places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids at some places of a list, end to end, and where each place's begin and all end."""
    flat = np.frombuffer(b"".join(found), np.int32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    out = []
    for low in range(0, len(places), _TAKEN):
        some = places[low : low + _TAKEN]
        ends = np.cumsum(sizes[some])
        shifts = starts[some] + sizes[some] - ends
        out.append(flat[np.repeat(shifts, sizes[some]) + np.arange(ends[-1])].tobytes())
    return b"".join(out), np.append(0, np.cumsum(sizes[places]))


class _Near:
    """The states of a word's last characters, as if they were all there are."""

    def __init__(self, states: deque, skipped: int):
        self.states, self.skipped = states, skipped

    def __getitem__(self, at: int) -> tuple:
        return self.states[at + self.skipped]


def _moved(state: tuple, by: int) -> tuple:
    return state[0], state[1] + by, *state[2:]


class Words:
    """The ids of words seen before; bounded in bytes, without long words."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.size = 0

    def bound(self, added: Iterable[str]) -> None:
        """Forget long words of those just added, and everything when there is too much."""
        for word in added:
            if len(word) >= _ALONE:
                del self.ids[word]
            else:
                # a text of wide characters takes four bytes each
                self.size += _OVERHEAD + 4 * len(word) + len(self.ids[word])
        if self.size > _CACHE:
            self.ids.clear()
            self.size = 0


class Shared:
    """A model as executors share it: parsed once per worker, with the words seen so far."""

    def __init__(self, data: bytes):
        self.data = data
        self.known = Words()

    @cached_property
    def model(self) -> Model:
        return Model(self.data)


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for value in texts:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoder(spark: SparkSession, model: bytes):
    """A function from a text column to a column of piece ids; every task encodes its own rows."""
    shared = spark.sparkContext.broadcast(Shared(model))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        here = shared.value
        for batch in batches:
            # ids outweigh their text, so a batch of texts may become several of ids
            for texts in _chunks(batch):
                yield _listed(here.model.encode_batch(texts, here.known))

    return encode


def round_trips(docs: DataFrame, model: bytes, *, id_col: str, text_col: str) -> DataFrame:
    """(id, ids, same): every text's ids, and whether they decode to it; null does to null.

    Encodes and decodes where the text lies, so ids are not sent back for it, some million
    characters at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Shared(model))
    kind = docs.schema[id_col].dataType
    names = ["id", "ids", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column(1)):
                found = here.model.encode_batch(texts, here.known)
                rows = batch.column(0).slice(done, len(texts))
                done += len(texts)
                same = [
                    t is None or here.model.decode(np.frombuffer(x, np.int32)) == t
                    for t, x in zip(texts, found, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([rows, _listed(found), pa.array(same)], names=names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, same boolean")


def _listed(found: list[bytes | None]) -> pa.Array:
    """Ids given as 32-bit numbers, as lists."""
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in found)])
    return pa.ListArray.from_arrays(
        pa.array(ends, type=pa.int32()),
        pa.array(np.frombuffer(b"".join(x or b"" for x in found), dtype=np.int32)),
        mask=pa.array(np.array([x is None for x in found], dtype=bool)),
    )


def decoder(spark: SparkSession, model: bytes):
    """A function from a column of piece ids to a text column."""
    shared = spark.sparkContext.broadcast(Shared(model))

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        here = shared.value
        for batch in batches:
            texts = [
                here.model.decode(x.values.to_numpy()) if x.is_valid else None for x in batch
            ]
            yield pa.array(texts, type=pa.string())

    return decode
