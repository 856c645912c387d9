from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callgauge.llm import alignment
from callgauge.llm.queries import BYTES_PATH, MODEL_PATH, op13_token_alignment

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def models():
    data = [Path(p.removeprefix("file://")).read_bytes() for p in (BYTES_PATH, MODEL_PATH)]
    return alignment.ByteBpe(data[0]), alignment.PieceModel(data[1])


def spans(lengths):
    end, out = 0, []
    for n in lengths:
        out.append((end, end + n))
        end += n
    return out


def brute(rows, a, b):
    """The contract, token by token; A by its own library."""
    docs = []
    for i, text in rows:
        links, groups, ids = [], [], ([], [])
        if text:
            whole = (" " + text).encode()
            ids = (
                a.library.encode(" " + text, add_special_tokens=False).ids,
                b.library.encode(text),
            )
            if any(b"".join(m.spelled[t] for t in x) != whole for m, x in zip((a, b), ids, strict=True)):
                ids = ([], [])
        at = [spans(len(m.spelled[t]) for t in x) for m, x in zip((a, b), ids, strict=True)]
        cuts = sorted({e for _, e in at[0]} & {e for _, e in at[1]})
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [
                ",".join(str(t) for t, (s, e) in zip(x, where, strict=True) if low <= s and e <= high)
                for x, where in zip(ids, at, strict=True)
            ]
            groups.append("|".join(sides))
        j0 = 0
        for x, (s, e) in zip(ids[0], at[0], strict=True):
            while j0 < len(at[1]) and at[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(at[1]) and at[1][j][0] < e:
                links.append((x, ids[1][j]))
                j += 1
        docs.append((i, ids, groups, links))
    held = Counter(p for d in docs for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (
            i,
            len(ids[0]),
            len(ids[1]),
            len(groups),
            len(links),
            sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for i, ids, groups, links in docs
    ]


def got(found):
    return sorted(map(tuple, found.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop_finds_lower_bounds(short, long):
    short, long = (np.array(sorted(x), dtype=np.int64) for x in (short, long))
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_quick_encoding_equals_the_library(models):
    a, _ = models
    assert a.quick is not None
    texts = ["it's 12ab  x\n\n y\t", "   ", "<|endoftext|>", "é漢字🙂 ", "a" * 3000, " " * 3000, "!?" * 900]
    for text in texts:
        assert a.encode(text) == a.library.encode(text, add_special_tokens=False).ids


ODD = [
    (1, None),
    (2, ""),
    (3, "a"),
    (4, "  two  spaces\nand a tab\t"),
    (5, "mark ▁ inside"),
    (6, "<|endoftext|> </s> <0x41> <unk>"),
    (7, "漢字とかな 🙂🙂 naïve"),
    (7, "漢字とかな 🙂🙂 naïve"),
    (None, "no id"),
    (8, "x" * 5000),
    (9, "word " * 3000),
    (10, "\u0000 zero ﻿"),
]


@pytest.mark.parametrize("block_bytes", [1, 200, 8 << 20])
def test_odd_rows_and_any_block_size(spark, models, block_bytes):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    df = df.withColumn("block", F.lit("x")).withColumn("id", F.lit(0)).withColumn("n", F.lit(1))
    found, pairs = alignment.align(df, *models, block_bytes=block_bytes)
    want = sorted(brute(ODD, *models), key=repr)
    assert got(found) == want
    assert pairs.groupBy("a").agg(F.max(F.col("best").cast("int")).alias("m")).filter("m = 0").count() == 0


def test_empty(spark, models):
    found, pairs = alignment.align(spark.createDataFrame([], SCHEMA), *models)
    assert found.collect() == [] and pairs.collect() == []


def test_query_equals_brute_force(spark, sf_dir, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = op13_token_alignment(spark, sf_dir)
    assert found.columns[:1] == ["doc_id"]
    assert got(found) == sorted(brute(rows, *models), key=repr)
