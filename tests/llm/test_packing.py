from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import packing

SCHEMA = "doc_id long, text string"


def plain_pack(lengths, sizes, cost):
    """The same rule by looking at every open bin."""
    left, bins, places = sum(lengths), [], []
    for need in lengths:
        fits = [b for b in bins if b["room"] >= need]
        if fits:
            room = min(b["room"] for b in fits)
            b = max((b for b in fits if b["room"] == room), key=lambda b: b["turn"])
        else:
            size = min((s for s in sizes if s >= need), key=lambda s: ((cost + s) / min(s, left), s))
            b = {"room": size, "used": 0, "id": len(bins)}
            bins.append(b)
        places.append((b["id"], b["used"]))
        b["room"] -= need
        b["used"] += need
        b["turn"] = len(places)
        left -= need
    return places, [min(s for s in sizes if s >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_matches_the_plain_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 129, size=300))[::-1].astype(np.int64)
    sizes = (16, 32, 64, 128)
    bins, offsets, shrunk = packing.pack_shard(lengths, sizes, 8.0)
    places, expected = plain_pack(lengths.tolist(), sizes, 8.0)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == places
    assert shrunk == expected
    waste = sum(shrunk) / lengths.sum() - 1
    assert waste < 0.08


def check(rows, texts, sizes):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.id, r.copy, texts.get(r.id) and len(texts[r.id].split())].append(r)
        if r.bin is None:
            assert r.length == 0
        else:
            bins[r.bin].append(r)
    for held in bins.values():
        end = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        size = {r.bin_size for r in held}
        assert len(size) == 1 and size == {min(s for s in sizes if s >= end)}
    return docs


def test_every_word_lands_once(spark):
    rng = np.random.default_rng(3)
    texts = {i: "w " * int(rng.integers(0, 200)) for i in range(400)}
    texts[1000] = "w " * 5000
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    sizes = (16, 32, 64)
    rows = packing.pack(df, length=packing.words("text"), sizes=sizes, shard=100).collect()
    docs = check(rows, texts, sizes)
    assert len(docs) == len(texts)
    for (_, _, n), parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.piece):
            assert r.start == at
            at += r.length
        assert at == (n or 0)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b"), (4, "a b"), (4, "a b c"), (None, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bin", F.lit(1)).withColumn("n", F.lit(2))
    got = packing.pack(df, length=packing.words("text"), sizes=(2, 4))
    found = sorted(((r.id, r.copy, r.length) for r in got.collect()), key=repr)
    assert found == sorted(
        [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 2), (4, 1, 2), (4, 0, 3), (None, 0, 1)], key=repr
    )
    assert packing.pack(df.limit(0), length=packing.words("text")).collect() == []


def test_words_are_split_at_ascii_space(spark):
    df = spark.createDataFrame([("a\x0bb c d\te",)], "text string")
    assert df.select(packing.words("text")).first()[0] == 4


@pytest.mark.parametrize(("piece", "size"), [(333, 1000), (334, 1500)])
def test_sizes_that_are_no_multiples_are_opened_by_what_fits(piece, size):
    lengths = np.full(300, piece, dtype=np.int64)
    bins, _, shrunk = packing.pack_shard(lengths, (1000, 1500), 16.0)
    assert set(shrunk) == {size}
    assert np.bincount(bins, weights=lengths).max() <= size


@pytest.mark.parametrize("seed", range(3))
def test_no_multiples_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1501, size=2000).astype(np.int64)
    bins, offsets, shrunk = packing.pack_shard(lengths, (400, 1000, 1500), 16.0)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    assert all(u <= s for u, s in zip(used, shrunk, strict=True))
    end = dict.fromkeys(range(len(shrunk)), 0)
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True)):
        assert o == end[b]
        end[b] += n


def test_registered_pieces(spark, sf_dir):
    from callgauge.llm.queries import QUERIES

    counts = QUERIES["op9_sentencepiece"](spark, sf_dir).collect()
    wanted = {r.doc_id: max(r.n_pieces or 0, 0) for r in counts}
    placed = defaultdict(int)
    for r in QUERIES["op5_best_fit_packing_pieces"](spark, sf_dir).collect():
        placed[r.doc_id] += r.length
        assert r.bin_size is None or r.offset + r.length <= r.bin_size
    assert placed == wanted
