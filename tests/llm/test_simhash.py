from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callgauge.llm import simhash
from callgauge.llm.graph import components

SCHEMA = "doc_id long, text string"


def plain_simhash(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    if len(words) < shingle:
        parts = [" ".join(words)]
    else:
        parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    """Components of distinct values by all pairs: value -> least value."""
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in combinations(sorted(prints), 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {p: root(p) for p in prints}


TEXTS = [
    "", "  \n", "one", "One TWO", "one two three", "a b c d e f g", "Ünï ÇÖDE Été x\x0by\x1cz",
    "repeat repeat repeat repeat", "word " * 70_000, "x" * 100_000,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("shingle", [1, 3])
def test_fingerprint(text, shingle):
    assert simhash.simhash(text.encode(), shingle) == plain_simhash(text, shingle)


def test_spark_hash_is_the_same(spark):
    value = spark.createDataFrame([("é b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert value % 2**64 == xxhash.xxh64_intdigest("é b c".encode(), 42)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def clustered(seed, n, centres):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(n // centres):
            p = c
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 5])):
                p ^= 1 << b
            out.add(signed(p))
    return sorted(out)


def labelled(spark, prints, distance, chosen=None, bucket=simhash.BUCKET):
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.links(df, distance, chosen, bucket)
    found = {r.node: r.component for r in components(links).collect()}
    return {p: found.get(p, p) for p in prints}, links


@pytest.mark.parametrize("bucket", [1, 32])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_components_match_all_pairs(spark, distance, bucket):
    prints = clustered(distance, 160, 5)
    got, links = labelled(spark, prints, distance, bucket=bucket)
    assert got == groups(prints, distance)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > distance).isEmpty()


def test_unequal_thresholds_find_the_same(spark):
    prints = clustered(9, 200, 6)
    bits = list(range(64))
    for chosen in (
        [(bits[:32], 1), (bits[32:], 0)],
        [(bits[:5], 0), (bits[5:20], 0), (bits[20:], 0)],
        [(bits[:10], 0), (bits[10:20], 1)],  # the rest has -1: 0 + 1 - 1 = 2 - 3 + 1
    ):
        assert labelled(spark, prints, 2, chosen, 8)[0] == groups(prints, 2)


def test_allocation_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(50):
        m = rng.randint(2, 4)
        costs = [{t: 0.0 if t < 0 else rng.random() * 10**t for t in (-1, 0, 1, 2)} for _ in range(m)]
        got = simhash.allocate(costs, 3 - m)
        best = min(
            sum(c[t] for c, t in zip(costs, ts, strict=True))
            for ts in np.ndindex(*([4] * m))
            for ts in [tuple(t - 1 for t in ts)]
            if sum(ts) == 3 - m
        )
        assert sum(got) == 3 - m
        assert sum(c[t] for c, t in zip(costs, got, strict=True)) == pytest.approx(best)


def test_correlated_bits_share_a_partition(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        p = rng.getrandbits(64)
        for a in range(0, 64, 8):  # bits a and a + 1..3 agree
            for b in range(1, 4):
                p = p & ~(1 << (a + b)) | ((p >> a & 1) << (a + b))
        rows.append((signed(p),))
    correlation = simhash.bit_correlations(spark.createDataFrame(rows, "fp long"))
    assert correlation[8, 9] > 0.99 and abs(correlation[4, 12]) < 0.3
    parts = simhash.group_bits(correlation, 4)
    where = {b: i for i, g in enumerate(parts) for b in g}
    assert sorted(where) == list(range(64))
    assert all(where[a] == where[a + 1] for a in range(0, 64, 8))


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 900: 500}


def test_documents(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(1000)}" for _ in range(600)]
    rows = [(7, None), (8, ""), (9, "a"), (9, "a"), (None, "b b b")]
    for i in range(60):
        text = list(base)
        text[rng.randrange(600)] = f"edit{i}"
        rows.append((100 + i, " ".join(text)))
    rows += [(300 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("id", F.lit(2))
    prints = {}
    for i, t in rows:
        p = plain_simhash(t)
        prints[p] = min((x for x in (prints.get(p), i) if x is not None), default=None)
    label = groups([signed(p) for p in prints], 2)
    least = {}
    for p, i in prints.items():
        root = label[signed(p)]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    wanted = sorted(
        ((i, signed(plain_simhash(t)), least[label[signed(plain_simhash(t))]]) for i, t in rows),
        key=repr,
    )
    got = simhash.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted
    kept = simhash.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (i for i, _, c in wanted if i == c), key=repr
    )


def test_no_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep(df).collect() == []


def test_keep_of_missing_and_repeated_ids(spark):
    rng = random.Random(9)

    def copies(n):
        base = [f"z{rng.randrange(10**6)}" for _ in range(600)]
        out = []
        for i in range(n):
            text = list(base)
            text[0] = f"edit{i}"
            out.append(" ".join(text))
        return out

    a, b, c, d, e = copies(3), copies(3), copies(3), copies(1), copies(2)
    rows = [(None, d[0]), (None, a[0]), (None, a[1]), (1, a[2])]  # alone; near copies of 1
    rows += [(2, b[0]), (5, b[1]), (5, c[0]), (6, c[1]), (6, b[2])]  # 5 is the smallest of c only
    rows += [(None, t) for t in e] + [(20, c[2])]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [(r.doc_id, r.text) for r in simhash.keep(df).collect()]
    label = groups({signed(plain_simhash(t)) for _, t in rows}, simhash.MAX_DISTANCE)
    part = [label[signed(plain_simhash(t))] for _, t in rows]
    assert len(kept) == len(set(part)) < len(rows)
    for p in set(part):
        ids = [i for (i, _), q in zip(rows, part, strict=True) if q == p]
        least = min((i for i in ids if i is not None), default=None)
        assert [i for i, t in kept if label[signed(plain_simhash(t))] == p] == [least]
