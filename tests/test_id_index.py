"""The id index: what it finds, what it opens, and loads that ask it."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgauge.sources import calls as call_table
from callgauge.sources import id_index
from callgauge.sources.id_index import Index

START = datetime(2024, 1, 1)
ROWS = "id string, created_at timestamp_ntz"


def some(spark, *numbers):
    """Ids over 40 months."""
    rows = [(f"id-{n}", START + timedelta(days=n % 1200)) for n in numbers]
    return spark.createDataFrame(rows, ROWS)


def found(df):
    return set() if df is None else {r.id for r in df.collect()}


@pytest.fixture
def index(tmp_path):
    return Index(str(tmp_path / "index dir"), buckets=8, words=64)


def test_an_empty_index_knows_nothing(spark, index, tmp_path):
    assert id_index.suspects(some(spark, 1), index) is None
    assert id_index.stored(some(spark, 1), index) is None
    assert id_index.lookup(spark, str(tmp_path / "none"), index, "id-1").isEmpty()
    id_index.add(some(spark), index, 0, "s")
    assert found(id_index.stored(some(spark, 1), index)) == set()
    assert found(id_index.stored(some(spark), index)) == set()
    assert not id_index.compact(spark, index, str(tmp_path / "copy")).root.endswith("dir")


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_finds_exactly_the_stored_ids_however_full_the_filter(spark, tmp_path, words):
    index = Index(str(tmp_path / "index"), buckets=4, words=words)
    id_index.add(some(spark, *range(0, 600, 3)), index, 0, "s")
    id_index.add(some(spark, *range(0, 600, 5)), index, 1, "s")
    asked = some(spark, *range(700), *range(50))  # with repeats
    stored = {f"id-{n}" for n in range(600) if n % 3 == 0 or n % 5 == 0}
    maybe = id_index.suspects(asked, index)
    assert found(maybe) >= stored and maybe.count() == len(found(maybe))
    if words > 1000:
        assert len(found(maybe)) < len(stored) + 20
    result = id_index.stored(asked, index)
    assert found(result) == stored and result.count() == len(stored)


def test_opens_only_the_buckets_of_suspected_ids(spark, tmp_path):
    index = Index(str(tmp_path / "index"), buckets=16)
    id_index.add(some(spark, *range(500)), index, 0, "s")
    assert found(id_index.stored(some(spark, *range(1000, 1300)), index)) == set()
    opened = id_index._read(spark, index, id_index.IDS, [3, 5]).inputFiles()
    assert opened and all("id_bucket=3/" in f or "id_bucket=5/" in f for f in opened)
    known = id_index.stored(some(spark, 7, 2000, 2001), index)
    assert {f.split("id_bucket=")[1].split("/")[0] for f in known.inputFiles() if "/ids/" in f} <= {
        str(r[0]) for r in some(spark, 7).select(id_index._bucket(index)).collect()
    }
    assert found(known) == {"id-7"}


def test_a_batch_does_not_meet_itself_and_replaces_its_own(spark, index):
    id_index.add(some(spark, 1, 2), index, 0, "s")
    id_index.add(some(spark, 2, 3), index, 1, "s")
    assert found(id_index.stored(some(spark, 1, 2, 3), index, 1, "s")) == {"id-1", "id-2"}
    assert found(id_index.stored(some(spark, 1, 2, 3), index, 1, "other")) == {"id-1", "id-2", "id-3"}
    id_index.add(some(spark, 2, 3), index, 1, "s")
    held = id_index._read(spark, index, id_index.IDS, None)
    assert sorted(r.id for r in held.collect()) == ["id-1", "id-2", "id-2", "id-3"]


def test_compaction_keeps_the_newest_batch_apart(spark, index, tmp_path):
    for batch in range(4):
        id_index.add(some(spark, *range(10 * batch, 10 * batch + 12)), index, batch, "s")
    copy = id_index.compact(spark, index, str(tmp_path / "copy"))
    for part in (id_index.IDS, id_index.FILTER):
        owners = id_index._read(spark, copy, part, None).select("load_stream", "load_batch").distinct()
        assert {tuple(r) for r in owners.collect()} == {(call_table.COMPACTED, 0), ("s", 3)}
    words = id_index._read(spark, copy, id_index.FILTER, None).groupBy("id_bucket", "load_batch", "word")
    assert words.count().where("count > 1").isEmpty()
    assert found(id_index.stored(some(spark, *range(60)), copy)) == {f"id-{n}" for n in range(42)}
    assert found(id_index.stored(some(spark, *range(60)), copy, 3, "s")) == {f"id-{n}" for n in range(32)}


def test_lookup_opens_the_months_of_the_id(spark, tmp_path):
    calls, index = str(tmp_path / "calls"), Index(str(tmp_path / "index"), buckets=8)
    rows = some(spark, *range(0, 1200, 20)).unionByName(
        spark.createDataFrame([("id-40", START + timedelta(days=400))], ROWS)
    )
    missing = [f for f in call_table.STORED_SCHEMA if f.name not in rows.columns]
    whole = rows.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in missing if f.name in call_table.CALL_COLUMNS}
    )
    call_table.append(whole, calls, 0, "s")
    id_index.build(spark, calls, index)
    row = id_index.lookup(spark, calls, index, "id-400")
    assert [r.created_at for r in row.collect()] == [START + timedelta(days=400)]
    assert len({f.split("created_month=")[1][:7] for f in row.inputFiles()}) == 1
    both = id_index.lookup(spark, calls, index, "id-40").collect()
    assert sorted(r.created_at for r in both) == [START + timedelta(days=d) for d in (40, 400)]
    assert id_index.lookup(spark, calls, index, "id-41").isEmpty()
