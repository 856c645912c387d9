from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from callgauge.llm import warc
from callgauge.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    last = {}
    for i, _, html in rows:
        key = html or ""
        last[key] = max((x for x in (last.get(key), i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        keep = last[html or ""]
        out.append(
            (
                i,
                len(body),
                base64.b32encode(hashlib.sha1(body).digest()).decode(),
                "response" if i == keep else "revisit",
                None if i == keep else keep,
            )
        )
    return sorted(out, key=repr)


def archived(spark, rows, path=None, **options):
    path = path or scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), path, **options)
    found = warc.read(spark, path)
    assert found.filter("NOT digest_ok").isEmpty()
    out = found.select(
        warc.page_id("record_id").cast("long"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id("refers_to").cast("long"),
    )
    return sorted((tuple(r) for r in out.collect()), key=repr)


def nested(payload: str) -> str:
    fields = "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>"
    return (
        f"WARC/1.0\r\n{fields}\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"
    )


ROWS = [
    (1, "http://a.example/1", "plain"),
    (2, "http://a.example/2", "plain"),
    (3, None, None),
    (4, "http://a.example/ x\r\ny", ""),
    (5, "u", "WARC/1.0\r\n"),
    (6, "u", "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n tail"),
    (7, "u", nested("inner") * 3),
    (8, "u", nested(nested("deep") + "WARC/1.0\r\n") + "\r\n\r\n\r\n\r\n"),
    (9, "u", "\r\n\r\n"),
    (10, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 999999999\r\n\r\n"),
    (11, "u", "ünïcödé ✓ " * 50),
    (12, "u", "plain"),
    (13, "u", "x" * 5000),
]


@pytest.mark.parametrize("split", ["150", "134217728"])
def test_archives_read_back_whatever_the_payload(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert archived(spark, ROWS) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_revisit_lists_join_instead_of_broadcast(spark, monkeypatch):
    small = warc.broadcast_if_small
    monkeypatch.setattr(warc, "broadcast_if_small", lambda df: small(df, max_rows=0))
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(60)]
    assert archived(spark, rows) == expected(rows)


def test_short_payloads_are_never_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = {r[0]: r[3] for r in archived(spark, rows, min_revisit_bytes=3)}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "p"), (1, "u", "p"), (1, "u", "p"), (None, "u", "q"), (2, "u", "r")]
    assert archived(spark, rows) == expected(rows)


def test_no_pages(spark):
    assert archived(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "u", "x", "a", "b", 1)], SCHEMA + ", digest string, refers_to string, id int"
    )
    path = scratch_path(spark, "warc")
    warc.write(df, path)
    assert warc.read(spark, path).count() == 1


def test_broken_chains_end_at_the_last_sound_record(spark):
    path = scratch_path(spark, "warc")
    good = nested("one") + nested("two")
    broken = spark.createDataFrame([(good + "garbage" + nested("three"),)], "v string")
    broken.coalesce(1).write.text(path)
    assert warc.read(spark, path).count() == 2
    other = scratch_path(spark, "warc")
    spark.createDataFrame([("no record " + good,)], "v string").coalesce(1).write.text(other)
    assert warc.read(spark, other).count() == 0


def test_base32_matches_the_library(spark):
    values = ["", "a", "é" * 9, "x" * 1000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(warc.base32_sha1(F.col("v").cast("binary"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(v.encode()).digest()).decode() for v in values]


def large_archives(spark, path, files=8, pages=60, size=100_000, magic=()):
    """``files`` archives of some 6 MB; pages in ``magic`` hold the magic line twice."""
    block = "<p>text of a page</p>\n" * (size // 22)
    html = F.concat(F.col("page_id").cast("string"), F.lit(block))
    nested_ = F.concat(html, F.lit("WARC/1.0\r\n"), html, F.lit(nested("x")))
    rows = spark.range(0, files * pages, 1, files).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url")
    )
    rows = rows.withColumn("html", F.when(F.col("page_id").isin(list(magic)), nested_).otherwise(html))
    warc.write(rows, path)
    return rows


def digests(df):
    return sorted((r.i, r.n, r.d) for r in df.collect())


@pytest.mark.parametrize("second", ["134217728", "700000"])
def test_no_record_is_lost_whatever_the_second_read_is_split_like(spark, monkeypatch, second):
    path = scratch_path(spark, "warc folder with a space and 100%")
    pages = large_archives(spark, path, magic=(3, 230, 479))
    want = digests(
        pages.select(
            F.col("page_id").cast("string").alias("i"),
            F.octet_length("html").cast("long").alias("n"),
            warc.base32_sha1(F.col("html").cast("binary")).alias("d"),
        )
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = warc._reassembled

    def other_splits(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", second)
        return whole(*args)

    monkeypatch.setattr(warc, "_reassembled", other_splits)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500000")
    try:
        found = warc.read(spark, path)
        got = digests(
            found.select(
                warc.page_id("record_id").alias("i"),
                F.col("payload_bytes").alias("n"),
                F.col("payload_digest").alias("d"),
            )
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_missing_pieces_are_an_error(spark, monkeypatch):
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", nested("x") * 3)], SCHEMA), path)
    other = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "changed")], SCHEMA), other)
    segments, reads = warc._segments, []

    def changed(spark_, path_):
        reads.append(path_)
        return segments(spark_, path_ if len(reads) == 1 else other)

    monkeypatch.setattr(warc, "_segments", changed)
    with pytest.raises(RuntimeError, match="changed"):
        warc.read(spark, path).collect()
