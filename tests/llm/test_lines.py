from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callgauge.llm import lines

SCHEMA = "page_id long, site string, text string"


def brute(rows, ratio, least):
    split = [(i, s or "", [x.strip(" ") for x in (t or "").split("\n")]) for i, s, t in rows]
    split = [(i, s, [x for x in ls if x]) for i, s, ls in split]
    pages = Counter(s for _, s, _ in split)
    seen = Counter((s, x) for _, s, ls in split for x in set(ls))
    out = []
    for i, s, ls in split:
        kept = [x for x in ls if pages[s] < least or seen[s, x] <= ratio * pages[s]]
        out.append((i, s, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [
    *((i, "a", f"menu\nstory {i}\n menu \n\nfooter" if i % 2 else f"menu\nstory {i % 5}") for i in range(20)),
    *((100 + i, "b", "menu\nrare" if i == 0 else f"text {i}") for i in range(10)),
    (200, None, "menu\nx"),
    (201, None, None),
    (202, "c", ""),
    (203, "c", "menu"),
    (203, "c", "menu"),
    (None, "a", "menu\nlonely"),
    (204, "a", "line\n" * 3000 + "end"),
]


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize(("ratio", "least"), [(0.2, 5), (0.5, 1), (0.0, 1), (1.0, 1)])
def test_matches_brute_force(spark, ratio, least, broadcast):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = lines.drop_boilerplate(
        df,
        id_col="page_id",
        host=F.col("site"),
        lines=lines.text_lines("text"),
        max_ratio=ratio,
        min_pages=least,
        broadcast_lines=broadcast,
    )
    assert got.columns == ["id", "host", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, ratio, least)


def test_no_pages_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [], SCHEMA + ", host string, lines string, common int, id int, pages int"
    )
    cut = lines.drop_boilerplate(
        df, id_col="page_id", host=F.col("site"), lines=lines.text_lines("text")
    )
    assert cut.collect() == []
    one = df.union(
        spark.createDataFrame([(1, "s", "x", "h", "l", 1, 2, 3)], df.schema)
    )
    cut = lines.drop_boilerplate(
        one, id_col="page_id", host=F.col("site"), lines=lines.text_lines("text")
    )
    assert [tuple(r) for r in cut.collect()] == [(1, "s", 1, 0, "x")]


def test_html_and_hosts(spark):
    html = (
        "<!DOCTYPE html><title>T</title><style>p{}</style><script>var t='</p>';</script>"
        "<P class='a'>one <b>two</b>\nthree</p><!-- c --><ul><li> x </li><li></li></ul>"
    )
    row = spark.createDataFrame([(html, "HTTP://u@Blog.Example.com:80/p?q#f")], "h string, u string")
    got = row.select(lines.html_lines("h"), lines.host_of("u")).first()
    assert got[0] == ["T", "one two three", "x"]
    assert got[1] == "blog.example.com"
    none = spark.createDataFrame([(None, None), ("", "no url")], "h string, u string")
    assert [tuple(r) for r in none.select(lines.html_lines("h"), lines.host_of("u")).collect()] == [
        ([], None),
        ([], None),
    ]


def test_plan_has_no_python(spark, sf_dir):
    from callgauge.llm.queries import op2_line_dedup

    plan = op2_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_small_hosts_are_cleaned(spark, tmp_path):
    from callgauge.llm.queries import QUERIES

    def pages(host, n):
        return [(f"http://{host}/{i}", f"<p>text {i}<footer>all</footer>") for i in range(n)]

    rows = [p for n in (1, 2, 3, 4, 5) for p in pages(f"h{n}", n)]
    rows = [(i, u, h) for i, (u, h) in enumerate(rows)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    found = QUERIES["op2_line_dedup_small_hosts"](spark, str(tmp_path)).collect()
    dropped = {(r.host, r.n_dropped, "text" in r.text) for r in found}
    assert dropped == {("h1", 0, True), *((f"h{n}", 1, True) for n in (2, 3, 4, 5))}


PARTS = (
    "<script |</script>|<SCRIPT>|</Script>|<!--|-->|<div |<p>|>|<|text|\n|<style>|</style>|<template x>|"
    "</template>|<noscript|</noscript>|İ|é|\r|<b>|</b>|<scripty>| "
).split("|")


def plain_lines(html):
    """Visible lines by the plain patterns, whose work may grow with the square of a page."""
    unseen = "|".join([*(rf"<{e}\b.*?</{e}>" for e in lines.UNSEEN), "<!--.*?-->"])
    text = re.sub(f"(?is){unseen}", " ", html)
    text = re.sub(r"[\r\n]", " ", text)
    text = re.sub(rf"(?i)</?(?:{'|'.join(lines.BLOCKS)})\b[^>]*>", "\n", text)
    text = re.sub("<[^>]*>", "", text)
    return [x for x in (x.strip(" ") for x in text.split("\n")) if x]


@pytest.mark.parametrize("few", [-1, 2, 64])
def test_markup_equals_the_plain_patterns(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "_FEW", few)
    rng = random.Random(few)
    pages = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, h string")
    got = {r.i: r.lines for r in df.select("i", lines.html_lines("h").alias("lines")).collect()}
    assert got == {i: plain_lines(p) for i, p in enumerate(pages)}


@pytest.mark.parametrize("piece", ["<!--", "<script ", "<div ", "<", "</script><script", "<style><!--"])
def test_markup_that_never_ends_takes_linear_time(spark, piece):
    page = spark.createDataFrame([(piece * (2_000_000 // len(piece)),)], "h string")
    page.select(F.size(lines.html_lines("h"))).collect()
    started = time.time()
    page.select(F.size(lines.html_lines("h"))).collect()
    assert time.time() - started < 15
