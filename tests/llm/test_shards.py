from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import shards
from callgauge.llm.queries import op11_feistel_shards

SCHEMA = "doc_id long, text string"


def brute(total, seed, shards_=24):
    """Shard and slot of every row number, number by number."""
    bits = max(2, (total - 1).bit_length())
    keys = shards.round_keys(seed)

    def mixed(x, key):
        x = (x + key) % 2**31
        x = ((x ^ (x >> 15)) * shards.MIX_A) % 2**31
        x = ((x ^ (x >> 12)) * shards.MIX_B) % 2**31
        return x ^ (x >> 15)

    def network(v):
        a, b = bits // 2, bits - bits // 2
        left, right = v >> b, v % 2**b
        for key in keys:
            left, right = right, (left + mixed(right, key)) % 2**a
            a, b = b, a
        return left * 2**b + right

    out = []
    for v in range(total):
        v = network(v)
        while v >= total:
            v = network(v)
        out.append((v % shards_, v // shards_))
    return out


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 8, 9, 31, 64, 65, 1000])
def test_permutation_and_its_inverse(total):
    at = shards.permuted(np.arange(total), total)
    assert sorted(at.tolist()) == list(range(total))
    want = brute(total, shards.SEED)
    for v in range(total):
        assert shards.place(v, total) == want[v]
        assert shards.row_at(*want[v], total) == v


def test_large_numbers_come_back():
    total = (1 << 45) + 12345
    v = np.random.default_rng(1).integers(0, total, 2000)
    at = shards.permuted(v, total)
    assert (at < total).all() and (at >= 0).all()
    assert shards._walked(shards._network_back, at, total, shards.SEED).tolist() == v.tolist()


def test_shuffle_is_mixed():
    at = shards.permuted(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), at)[0, 1]) < 0.02
    neighbours = np.abs(np.diff(at)) < 1000
    assert neighbours.mean() < 0.04
    assert (shards.permuted(np.arange(1000), 1000, seed=1) != shards.permuted(np.arange(1000), 1000, seed=2)).mean() > 0.95


def test_query_equals_brute_force_whatever_the_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = sorted(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", *at, None)
        for (i, t), at in zip(rows, brute(len(rows), shards.SEED), strict=True)
    )
    docs.repartition(7, F.rand(3)).write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (sf_dir, str(tmp_path)):
        assert sorted(map(tuple, op11_feistel_shards(spark, folder).collect())) == want


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, "x"), (1, "x"), (1, "y"), (2, "z" * 100_000)] + [(3, "same")] * 50
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("pos", F.lit(1))
    found = shards.assign(df, order_by=("doc_id", "text"), shards=5)
    assert found.columns == ["doc_id", "text", "pos", "row_number", "shard", "slot"]
    out = found.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert sorted(r.row_number for r in out) == list(range(len(rows)))
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    sizes = df.select(*shards.sizes("text")).collect()
    assert (sizes[0].size, sizes[0].text_crc32) == (8, 0) and sizes[5].size == 100_008


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert len({(r.shard, r.slot) for r in shards.assign(df, order_by=["doc_id"]).collect()}) == 2
    assert shards.assign(df.limit(0), order_by=["doc_id"]).collect() == []


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards.write(docs, str(tmp_path / "out"), order_by=["doc_id"], shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in docs.collect())
    total = back.count()
    one = back.filter("shard = 3 AND slot = 7").first()
    assert one.row_number == shards.row_at(3, 7, total, 4)
    assert {r.shard: r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {
        s: total // 4 + (s < total % 4) for s in range(4)
    }
