from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callgauge.llm import lm
from callgauge.llm.common import table

SCHEMA = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out = lowered(text)
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute(rows, order, backoff):
    docs = [words(t) for _, t in rows]

    def grams(ws):
        found = Counter({(): len(ws)})
        for k in range(1, order + 1):
            found.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        return found

    total = Counter()
    for ws in docs:
        total.update(grams(ws))
    out = []
    for (i, _), ws in zip(rows, docs, strict=True):
        own = grams(ws)
        rest = {g: total[g] - own[g] for g in own}

        def score(w, context, rest=rest):
            if not context:
                return max(rest[(w,)], 1) / max(rest[()], 1)
            if rest[(*context, w)] > 0:
                return rest[(*context, w)] / rest[tuple(context)]
            return backoff * score(w, context[1:])

        log, backed = 0.0, 0
        for at, w in enumerate(ws):
            context = ws[max(0, at - order + 1) : at]
            log += math.log(score(w, context))
            backed += len(context) == order - 1 > 0 and rest[(*context, w)] == 0
        out.append((i, len(ws), backed, round(log, 6)))
    return sorted(out, key=repr)


ROWS = [
    (1, "The cat sat on the mat"),
    (2, "the CAT sat\ton a mat"),
    (3, "a dog  sat on the\nmat"),
    (4, None),
    (5, ""),
    (6, " \n "),
    (7, "lonely"),
    (8, "the the the the"),
    (9, "the cat sat on the mat"),
    (9, "the cat sat on the mat"),
    (None, "the cat é sat"),
    (10, "on the mat " * 3000),
    *((100 + i, f"the cat sat {i}") for i in range(200)),
]


@pytest.mark.parametrize("block_bytes", [2_000, lm.BLOCK_BYTES])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order, block_bytes):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df = df.withColumn("block", F.lit("x")).withColumn("id", F.lit("y"))
    got = lm.score(df, order=order, block_bytes=block_bytes)
    assert got.columns == ["id", "n_words", "n_backoff", "log_score", "mean_log_score"]
    found = got.collect()
    rows = sorted(((r.id, r.n_words, r.n_backoff, round(r.log_score, 6)) for r in found), key=repr)
    assert [r[:3] for r in rows] == [r[:3] for r in brute(ROWS, order, lm.BACKOFF)]
    for a, b in zip(rows, brute(ROWS, order, lm.BACKOFF), strict=True):
        assert a[3] == pytest.approx(b[3], abs=2e-6)
    for r in found:
        assert (r.mean_log_score is None) == (r.n_words == 0)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a b")], SCHEMA)
    assert lm.score(df.limit(0)).collect() == []
    r = lm.score(df).first()
    assert (r.n_words, r.n_backoff) == (2, 1)
    assert r.log_score == pytest.approx(math.log(lm.BACKOFF))


def test_text_ids(spark):
    df = spark.createDataFrame([("x", "a b"), (None, "a b")], "doc_id string, text string")
    assert {r.id for r in lm.score(df).collect()} == {"x", None}


def test_registered_order_3(spark, sf_dir):
    from callgauge.llm.queries import QUERIES

    docs = table(spark, sf_dir, "documents")
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], 3, lm.BACKOFF)
    found = QUERIES["op7_lm_score_order3"](spark, sf_dir).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_backoff, r.log_score) for r in found), key=repr)
    assert [r[:3] for r in rows] == [r[:3] for r in wanted]
    for a, b in zip(rows, wanted, strict=True):
        assert a[3] == pytest.approx(b[3], abs=1e-4)
