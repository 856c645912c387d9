from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callgauge.llm import secrets, toxicity
from callgauge.llm.common import table
from test_exact import lowered
from test_simhash import groups, plain_simhash, signed


def test_run_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if not toxicity.predict(model, r[1])[2]]
    last = {}
    for i, t in rows:
        last[lowered(t)] = max(i, last.get(lowered(t), i))
    rows = [(i, t) for i, t in rows if last[lowered(t)] == i]
    prints = {i: signed(plain_simhash(t)) for i, t in rows}
    label = groups(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    rows = [(i, secrets.mask(t)) for i, t in rows if least[label[prints[i]]] == i]
    words = {i: len((t or "").encode().split()) for i, t in rows}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    placed = {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == words
    used = {}
    for r in got:
        if r.bin is not None:
            used[r.bin, r.bin_size] = used.get((r.bin, r.bin_size), 0) + r.length
    assert len({b for b, _ in used}) == len(used)
    assert all(n <= size for (_, size), n in used.items())


@pytest.fixture
def odd_dir(spark, tmp_path):
    """Documents with nulls, repeated rows and columns named like the operators' own."""
    rows = [
        (1, "a calm text token=abcdefghij", "en", "s", 28),
        (1, "a calm text token=abcdefghij", "en", "s", 28),
        (2, "A CALM text token=abcdefghij", None, None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (None, "no id here at all", "en", "s", 17),
        (5, "word " * 30_000, "en", "s", 150_000),
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    for c in ("id", "sha", "fp", "bin", "copy", "severity", "component", "length"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    return str(tmp_path)


def test_odd_rows_pass_every_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_dir)
        assert docs.columns == columns, name
    kept = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    # the largest id of equal texts stays; null and empty texts are equal and hash to zero
    assert set(kept) == {None, 2, 4, 5}
    assert kept[2] == ("A CALM text token=[SECRET]", 26)
    packed = corpus_pipeline.run(spark, odd_dir).collect()
    assert sum(r.length for r in packed if r.doc_id == 5) == 30_000


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, stage):
    docs = table(spark, sf_dir, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir).collect() == []
