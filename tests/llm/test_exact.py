from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from callgauge.llm import exact

SCHEMA = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        sha = hashlib.sha256(lowered(t).encode()).hexdigest()
        out.append((i, keep, len(ids), i == keep, sha))
    return sorted(out, key=repr)


ROWS = [
    *((i, f"Text {i % 70}") for i in range(100)),
    *((1000 + i, "HOT copy") for i in range(300)),
    (2000, "hot COPY"),
    (2001, None),
    (2002, ""),
    (2003, "É"),
    (2004, "é"),
    (2005, "long " * 100_000),
    (2006, "LONG " * 100_000),
    (2007, "same row"),
    (2007, "same row"),
    (None, "no id"),
    (None, "no id too"),
    (2008, "no id"),
    (2009, "K"),  # the Kelvin sign is no K
    (2010, "k"),
]


@pytest.mark.parametrize("max_bits", [1 << 16, exact.MAX_BITS])
def test_groups_match_brute_force(spark, max_bits):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = exact.groups(df, max_bits=max_bits)
    assert got.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_a_full_filter_only_costs_shuffle(spark):
    rows = [(i, f"text {i % 30_000}") for i in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = exact.groups(df, max_bits=1 << 16)
    assert got.filter("group_size = 2").count() == 20_000
    assert got.filter("kept").count() == 30_000


def test_filter_finds_every_repetition_and_little_else(spark):
    rows = [(i, f"text {i if i < 9000 else i - 500}") for i in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    hashed = df.select("doc_id", exact.text_sha256("text").alias("sha"))
    flagged = hashed.filter(exact.maybe_repeated(hashed, "sha"))
    ids = {r.doc_id for r in flagged.collect()}
    assert set(range(8500, 9500)) <= ids
    assert len(ids) < 1100


def test_keep_returns_whole_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("sha", F.lit("x")).withColumn("id", F.lit(1))
    df = df.withColumn("maybe", F.lit(None).cast("int"))
    got = exact.keep(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    texts = {}
    for i, keep, _, kept_row, sha in brute(ROWS):
        if kept_row:
            texts[sha] = keep
    assert sorted((i for i, _ in kept), key=repr) == sorted(texts.values(), key=repr)
    assert len({lowered(t) for _, t in kept}) == len(kept)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact.groups(df).collect() == []
    assert exact.keep(df).collect() == []
