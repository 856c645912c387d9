from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from callgauge.llm import pieces
from callgauge.llm.common import table

PATH = "/opt/tokenizers/piece_bpe_32k.model"

TEXTS = [
    "", " ", "  ", "a", "a  b", "  lead", "trail ", "tab\tx\n\ny", "The quick brown fox's 12,345.67!",
    "é▁x ▁", "　x", "\x00a", "<s> </s> <unk> <0x41>", "日本語テキスト 한국어 emoji 🙂🙃", "a" * 3000,
    " " * 100 + "x", "Straße ÜBER naïve coöperate", "def f(x):\n    return x  # ok\n", "‍﻿",
    "aaa bbb" * 50,
]


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(model, text):
    words = model.words(text)
    known = model.encode_words(set(words))
    return [i for w in words for i in known[w]]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(data, library, text):
    model = pieces.Model(data)
    assert encoded(model, text) == library.encode(text)
    assert model.decode(encoded(model, text)) == library.decode(library.encode(text))


def test_random_texts(data, library):
    rng = random.Random(1)
    model = pieces.Model(data)
    letters = "abcdeinorst" * 3 + "ABZ019.,'-  \n" + "éüß▁中я"
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randrange(80)))
        assert encoded(model, text) == library.encode(text)


def test_sample_documents(spark, data, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(150)
    encode = pieces.encoder(spark, pieces.read_model(spark, f"file://{PATH}"))
    for text, ids in docs.select("text", encode("text")).collect():
        assert ids == library.encode(text)


def unigram(data):
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = pieces.UNIGRAM
    rng = random.Random(3)
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -rng.uniform(1, 12) - (0 if len(p.piece) > 1 else 4)
    return proto.SerializeToString()


def best_score(model, text):
    """The best total by a plain forward pass over the whole marked text."""
    text = model.marked(text)
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - 1] + model.floor]
        for start in range(max(0, end - model.longest), end):
            if text[start:end] in model.ids:
                options.append(best[start] + model.scores[text[start:end]])
        best.append(max(options))
    return best[-1]


def test_unigram_models_take_the_best_segmentation(data):
    changed = unigram(data)
    model = pieces.Model(changed)
    library = sentencepiece.SentencePieceProcessor(model_proto=changed)
    for text in ["The quick brown fox", "internationalization of words", "a b  c", "unbelievable"]:
        ids = encoded(model, text)
        total = sum(model.scores[model.texts[i]] for i in ids)
        assert total == pytest.approx(best_score(model, text))
        assert ids == library.encode(text)


def test_common_prefixes_are_walked_once(data, monkeypatch):
    model = pieces.Model(data)
    steps = []
    step = model.step_bpe
    monkeypatch.setattr(model, "step_bpe", lambda *a: (steps.append(a[:2]), step(*a))[1])
    words = {"▁inter", "▁internal", "▁international", "▁internet"}
    model.encode_words(words)
    assert len(steps) == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_columns(spark, data):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x"))
    encode, decode = pieces.encoder(spark, data), pieces.decoder(spark, data)
    got = df.select("doc_id", encode("text").alias("i")).select("doc_id", "i", decode("i"))
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found[0] == (1, None, None) and found[1] == (2, [], "")
    assert found[2] == found[3] and found[2][2] == "a b"
    assert found[4][2] == " "  # the mark itself reads as a space
    assert df.limit(0).select(encode("text")).collect() == []


def test_other_kinds_are_refused(data):
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 3
    with pytest.raises(ValueError):
        pieces.Model(proto.SerializeToString())


LONG = [
    "a" * 3000,
    "internationalization" * 400,
    "".join(chr(0x4E00 + i * 7 % 3000) for i in range(3000)),
    "漢字かな交じり文" * 300 + "abc" * 100,
    "x🙂" * 500 + " and words " + "y" * 70,
    "aB3" * 30 + "▁" + "q" * 500,
    "=" * 200 + "-" * 200 + "0123456789" * 30,
]


def test_long_words_equal_the_library(data):
    model, library = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in LONG:
        assert encoded(model, text) == library.encode(text)


def test_long_words_of_unigram_models_take_the_best_segmentation(data):
    model = pieces.Model(unigram(data))
    for text in LONG[:2]:
        total = sum(model.scores[model.texts[i]] for i in encoded(model, text))
        assert total == pytest.approx(best_score(model, text))


def test_parts_of_long_words_meet_where_no_piece_can_lie(data):
    model = pieces.Model(data)
    for text in LONG:
        for word in model.word.findall(model.marked(text)):
            parts = model.cut(word)
            assert "".join(parts) == word
            ends = np.cumsum([len(p) for p in parts])[:-1]
            assert all(word[e - 1 : e + 1] not in model.neighbours for e in ends)


def test_what_a_worker_remembers_is_bounded(data, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 100_000)
    model, known = pieces.Model(data), pieces.Words()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    for _ in range(20):
        texts = ["".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(1000)) for _ in range(5)]
        texts += [f"word{rng.randrange(10**9)} " * 3 + "z" * 900, None, ""]
        got = model.encode_batch(texts, known)
        assert [None if g is None else np.frombuffer(g, np.int32).tolist() for g in got] == [
            None if t is None else library.encode(t) for t in texts
        ]
        assert all(len(w) < pieces._ALONE for w in known.ids)
        assert known.size <= 100_000
        assert known.size == sum(pieces._OVERHEAD + 4 * len(w) + len(i) for w, i in known.ids.items())


def test_a_million_characters_without_a_space(data):
    model, known = pieces.Model(data), pieces.Words()
    tracemalloc.start()
    got = model.encode_batch(["ab1" * 330_000], known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.decode(np.frombuffer(got[0], np.int32)) == "ab1" * 330_000
    assert peak < 150 << 20 and all(len(w) < 4 for w in known.ids)


def test_round_trips_equal_encoding_and_decoding(spark, data):
    rows = [(1, None), (None, ""), (3, "a b"), (3, "a b"), (4, "▁"), (5, "漢字 " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x"))
    encode, decode = pieces.encoder(spark, data), pieces.decoder(spark, data)
    want = df.select("doc_id", encode("text").alias("i"), "text").select(
        "doc_id", "i", decode("i").eqNullSafe(F.col("text"))
    )
    got = pieces.round_trips(df, data, id_col="doc_id", text_col="text")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert pieces.round_trips(df.limit(0), data, id_col="doc_id", text_col="text").collect() == []


def test_what_lies_between_cuts_is_walked_once(data, library, monkeypatch):
    model = pieces.Model(data)
    steps = []
    step = model.step_bpe
    monkeypatch.setattr(model, "step_bpe", lambda *a: (steps.append(a[:2]), step(*a))[1])
    assert "e\n" not in model.neighbours and "\nb" not in model.neighbours
    rng = random.Random(7)
    some = ["".join(rng.choices("aeinorst", k=8)) + "e" for _ in range(30)]
    other = ["b" + "".join(rng.choices("aeinorst", k=8)) for _ in range(30)]
    texts = [f"{a}\n{b} {b}" for a in some for b in other]
    got = model.encode_batch(texts, pieces.Words())
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t) for t in texts]
    # prefixes of 30 words each; as whole words the texts would have 30 x 30 x 9 more
    assert len(steps) <= 30 * 10 + 30 * 9 + 30 * 10 + 2


def test_batches_of_any_shape_equal_the_library(data, library, monkeypatch):
    monkeypatch.setattr(pieces, "_TAKEN", 3)
    model, known = pieces.Model(data), pieces.Words()
    mixed = ["", "a b", "", "🙂中\n", "a b", None]
    for texts in ([], [None], [""], ["", None, ""], ["x"], mixed, TEXTS + LONG):
        got = model.encode_batch(texts, known)
        assert [None if g is None else np.frombuffer(g, np.int32).tolist() for g in got] == [
            None if t is None else library.encode(t) for t in texts
        ]


def test_pieces_across_marks_keep_their_neighbours_together(data):
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    piece = proto.pieces.add()
    piece.piece, piece.score, piece.type = "s▁o", 0.0, pieces.NORMAL
    changed = unigram(proto.SerializeToString())
    model, known = pieces.Model(changed), pieces.Words()
    library = sentencepiece.SentencePieceProcessor(model_proto=changed)
    for text in ["gusts of wind", "pass on, as one"]:
        assert np.frombuffer(model.encode_batch([text], known)[0], np.int32).tolist() == library.encode(text)


def test_pairs_that_share_a_slot_with_neighbours_change_nothing(data, library):
    model = pieces.Model(data)
    model.beside = np.ones(2, dtype=bool)  # every pair shares one, so only marks cut
    assert model.words("a-b, c\n d") == ["▁a-b,", "▁c\n", "▁d"]
    for text in TEXTS + LONG[:2]:
        got = model.encode_batch([text, text], pieces.Words())
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(text)] * 2
