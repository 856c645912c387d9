from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from callgauge.llm import merkle
from callgauge.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    i, text, lang, source, _ = row

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(field, (i, source, lang, n_chars, text)))


def tree(nodes, arity):
    """Root and, per leaf, (left, right) siblings of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            start = i - i % arity
            p.append((nodes[start:i], nodes[i + 1 : start + arity]))
        at = [i // arity for i in at]
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], leaf(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]], arity)
    root, above = tree([trees[g][0] for g in order], arity) if order else (None, [])
    out = []
    for g, top in zip(order, above, strict=True):
        for (i, own, row), path in zip(groups[g], trees[g][1], strict=True):
            path = path + top
            n = row[4]
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None:
                n += 1
            at = leaf(row, n)
            for left, right in path:
                at = h(*left, at, *right)
            proof = h(*(x for left, right in path for x in left + right))
            out.append((i, own, trees[g][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def got(found):
    return sorted(map(tuple, found.collect()), key=repr)


def rows_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


def test_query_equals_brute_force(spark, sf_dir):
    want = brute(rows_of(spark, sf_dir))
    found = got(op12_merkle_manifest(spark, sf_dir))
    assert found == want
    assert 0 < sum(not r[-1] for r in found) < len(found) / 4


ODD = [
    (None, None, None, None, None),
    (None, None, None, None, None),
    (5, "é漢", "", "s", 2),
    (5, "other", "", "s", 5),
    (1, "x" * 300_000, "en", None, 300_000),
    *[(7, "same", "fr", "web", 4)] * 9,
    *[(i, f"text {i}", "zh-é", "web", 6) for i in range(33)],
    (2, "alone", "aa", "web", 5),
]


def digested(df, arity):
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(df, changed={"n_chars": tampered}, arity=arity)
    again = merkle.folded(F.col("current"), F.col("path"))
    return found.select("id", "leaf", "subroot", "root", "proof_sha256", again, again == F.col("root"))


@pytest.mark.parametrize("arity", [2, 3])
def test_odd_rows(spark, tmp_path, arity):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    df = df.withColumn("hash", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("n", F.lit(1))
    assert got(digested(df, arity)) == brute(ODD, arity)


def test_small_stretches_and_a_group_per_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRETCH", 2)
    monkeypatch.setattr(merkle, "STORE_EVERY", 2)
    rows = [(i, f"t{i}", "en", "web", 2) for i in range(40)]
    assert got(digested(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows)
    rows = [(i, f"t{i}", f"g{i}", "web", 2) for i in range(19)]
    assert got(digested(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows)


def test_one_row_and_none(spark):
    one = [(1, "a", "en", "web", 1)]
    assert got(digested(spark.createDataFrame(one, SCHEMA), 2)) == brute(one)
    assert digested(spark.createDataFrame([], SCHEMA), 2).collect() == []
    alone = merkle.manifest(spark.createDataFrame(one, SCHEMA)).first()
    assert alone.current == alone.leaf == alone.root and alone.path == []
