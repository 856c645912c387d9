"""Every registered query against its SQL twin on the smallest sample."""

from __future__ import annotations

import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from callgauge.checks.oracles import REASONS
from callgauge.operators import validation
from callgauge.plans import tables
from callgauge.schema import RECORD_FIELDS
from check import TABLES, _rows

ORACLES = oracle_sql()
CORPUS = {n for n in queries() if re.match(r"op[0-9]+_|pipeline", n)}
STREAMS = [name for name in queries() if name.startswith("stream_")]


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    df = queries()[name](spark, sf_dir)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


def test_only_estimates_lack_sql():
    assert set(queries()) - set(ORACLES) - CORPUS == {"rollup_daily_sketched"}


def test_sketched_percentiles_are_close(spark, sf_dir):
    """A sketch may be off by a small share of the ranks, never outside the data."""
    rows = queries()["rollup_daily_sketched"](spark, sf_dir).collect()
    exact = {
        (r.day, r.provider, r.model, r.status): r.n
        for r in queries()["rollup_daily"](spark, sf_dir).collect()
    }
    assert {(r.day, r.provider, r.model, r.status): r.n for r in rows} == exact
    assert all(r.p50_latency_ms <= r.p95_latency_ms <= r.p99_latency_ms for r in rows)


def test_sample_feed_breaks_every_rule():
    rules = {f"{f.name}:{rule}" for f in RECORD_FIELDS for rule in validation._rules(f)}
    rules |= {f"{f.name}:missing" for f in RECORD_FIELDS if f.required}
    broken = {reason for reasons in REASONS for reason in reasons.split(",")}
    assert broken - rules == {"payload:malformed", "record:unknown_key"}
    assert not rules - broken
    assert len(REASONS) == len(tables.FLAWS)


def test_sample_texts_hit_every_rule(spark, sf_dir):
    rows = queries()["redaction_report"](spark, sf_dir).collect()
    assert len(rows) == 7 and all(r.rows_hit > 0 for r in rows)
