"""One query per operator: ``(spark, sf_dir) -> DataFrame``.

Each query reads its whole input tables. Float results that depend on the order of
summation are rounded, as the SQL twin does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgauge.functions import outcome, plugins, redaction
from callgauge.functions.expressions import bind
from callgauge.functions.metadata import flag_if, member, merge_objects
from callgauge.operators import (
    assembly,
    chat,
    chat_store,
    context,
    loading,
    pricing,
    records,
    responses,
    validation,
)
from callgauge.plans import incremental, reports, rollup, tables
from callgauge.plans import sessions as session_shares
from callgauge.schema import CALL_COLUMNS
from callgauge.session import scratch_path
from callgauge.sources import calls as call_table
from callgauge.sources import catalogs, id_index, keyed, snapshots
from callgauge.sources import feed as feeds
from callgauge.streaming import assembly as live_assembly
from callgauge.streaming import closing, late
from callgauge.streaming import load as live_load
from callgauge.streaming import rollup as live_rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOURS = 720
DAYS = 30
SESSION = "00000000-0000-4000-9000-000000000007"
CALL = "00000000-0000-4000-8000-000000000042"
CUSTOM_CAPS = {"gpt-4o-mini": 1, "gpt-4o": 2}
CHAT_USER = "00000000-0000-4000-c000-000000000003"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Costs have eight decimals of their own, so they are rounded at the ninth."""
    return df.withColumns({c: F.round(c, 9 if "cost" in c else 6) for c in columns})


# --- reports ------------------------------------------------------------------------


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.latency(tables.calls(spark, sf_dir), tables.AS_OF, HOURS)
    return rounded(report, *[c for c in report.columns if c.startswith("p") and c != "provider"])


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.throughput(tables.calls(spark, sf_dir), tables.AS_OF, HOURS)
    return rounded(report, "total_latency_s", "tokens_per_second")


@query
def status_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_by_hour(tables.calls(spark, sf_dir), tables.AS_OF, HOURS)


@query
def cost_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.cost_by_day(tables.calls(spark, sf_dir), tables.AS_OF, DAYS), "cost_usd")


@query
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.session_activity(tables.calls(spark, sf_dir)), "cost_usd")


@query
def session_activity_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session activity from the shares of four loads, folded, the last one repeated."""
    root = scratch_path(spark, "sessions")
    calls = tables.calls(spark, sf_dir)
    fourth = F.right("id", F.lit(12)).cast("bigint") % 4
    for batch in range(4):
        session_shares.store_batch(calls.where(fourth == batch), f"{root}/loads", batch, "s")
    session_shares.fold(spark, f"{root}/loads", f"{root}/folded")
    session_shares.store_batch(calls.where(fourth == 3), f"{root}/folded", 3, "s")
    return rounded(session_shares.activity(spark, f"{root}/folded"), "cost_usd")


@query
def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.session_calls(tables.calls_with_texts(spark, sf_dir), SESSION)


@query
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.kpis(tables.calls(spark, sf_dir), tables.AS_OF, HOURS, DAYS)
    return rounded(summary, "error_rate_pct", "error_rate_all_pct", "cost_usd")


@query
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.hourly(tables.calls(spark, sf_dir), tables.AS_OF, DAYS, with_sketches=False)
    floats = [c for c in rows.columns if c.startswith(("p50", "p95", "p99", "total"))]
    return rounded(rows, *floats)


@query
def rollup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.reaggregate(_hourly_sums(spark, sf_dir), "day")
    return rounded(rows, "total_latency_ms", "total_cost")


def _hourly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive part of the rollup."""
    calls = call_table.since(tables.calls(spark, sf_dir), tables.AS_OF, 24 * DAYS)
    return rollup.sums_by_hour(calls, with_sketches=False)


@query
def rollup_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rollup.throughput(_hourly_sums(spark, sf_dir), tables.AS_OF, HOURS)
    return rounded(report, "total_latency_s", "tokens_per_second")


@query
def rollup_status_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.status_by_hour(_hourly_sums(spark, sf_dir), tables.AS_OF, HOURS)


@query
def rollup_cost_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rollup.cost_by_day(_hourly_sums(spark, sf_dir), tables.AS_OF, DAYS)
    return rounded(report, "cost_usd")


@query
def rollup_daily_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily percentiles from merged hourly sketches (estimates, so no SQL twin)."""
    hourly = rollup.hourly(tables.calls(spark, sf_dir), tables.AS_OF, DAYS)
    return rollup.reaggregate(hourly, "day").drop(*rollup.SKETCHES)


@query
def rollup_sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether daily percentiles from merged sketches are where their rank should be.

    An estimate is right if the share of values below it is at most the wanted one and the
    share up to it at least that, give or take half a percent. A group without values has
    neither an estimate nor an answer; an estimate that is missing elsewhere is wrong.
    """
    calls = tables.calls(spark, sf_dir)
    daily = rollup_daily_sketched(spark, sf_dir)
    keys = ["day", "provider", "model", "status"]
    recent = call_table.since(calls, tables.AS_OF, 24 * DAYS)
    dated = recent.withColumn("day", F.date_trunc("day", "created_at").cast("timestamp_ntz"))
    both = dated.join(daily, keys)

    def placed(p: float, estimate: Column, value: Column) -> Column:
        n = F.nullif(F.count(value), F.lit(0))
        below, upto = F.count_if(value < estimate) / n, F.count_if(value <= estimate) / n
        right = (below <= p + 0.005) & (upto >= p - 0.005) & (F.count(estimate) > 0)
        return F.when(n > 0, right)

    return both.groupBy(*keys).agg(
        F.count("latency_ms").alias("n_latency"),
        F.count("ttft_ms").alias("n_ttft"),
        *[
            placed(p, F.col(f"{name}_{m}_ms"), F.col(f"{m}_ms")).alias(f"{name}_{m}_right")
            for m in ("latency", "ttft")
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
        ]
    )


@query
def rollup_daily_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact daily percentiles from the stored histograms of three loads."""
    path = scratch_path(spark, "histograms")
    calls = tables.calls(spark, sf_dir)
    third = F.right("id", F.lit(12)).cast("bigint") % 3
    for batch in range(3):
        call_table.replace_batch(rollup.histograms(calls.where(third == batch)), path, batch, "s")
    daily = rollup.exact_percentiles(spark.read.parquet(path), calls)
    return rounded(daily, *[c for c in daily.columns if c.startswith(("p50", "p95", "p99"))])


@query
def rollup_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollup after two refreshes of the same days."""
    path = scratch_path(spark, "rollup")
    calls = tables.calls(spark, sf_dir)
    rollup.refresh(calls, path, tables.AS_OF, 15)
    rollup.refresh(calls, path, tables.AS_OF, DAYS)
    stored = rollup.read(spark, path).drop(*rollup.SKETCHES, "day")
    floats = [c for c in stored.columns if c.startswith(("p50", "p95", "p99", "total"))]
    return rounded(stored, *floats)


@query
def rollup_refresh_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollup after the calls of every third day were removed."""
    path = scratch_path(spark, "rollup")
    calls = tables.calls(spark, sf_dir)
    rollup.refresh(calls, path, tables.AS_OF, DAYS)
    left = calls.where(F.dayofmonth("created_at") % 3 != 0)
    rollup.refresh(left, path, tables.AS_OF, DAYS)
    stored = rollup.read(spark, path).drop(*rollup.SKETCHES, "day")
    floats = [c for c in stored.columns if c.startswith(("p50", "p95", "p99", "total"))]
    return rounded(stored, *floats)


@query
def rollup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after four refreshes by what changed, and when each row was last computed.

    The first loads hold most calls before the 25th, then those from the 25th on, then a
    fiftieth of the early ones, late; at last the calls of the 9th are removed.
    """
    root = scratch_path(spark, "incremental")
    calls = tables.calls(spark, sf_dir)
    late = F.right("id", F.lit(12)).cast("bigint") % 50 == 7
    early = F.col("created_at") < F.lit("2024-01-25").cast("timestamp_ntz")

    def refresh(rows: DataFrame) -> snapshots.Snapshot:
        return incremental.refresh(rows, f"{root}/changes", f"{root}/rollup", tables.AS_OF, DAYS)

    for batch, part in enumerate((early & ~late, ~early, early & late)):
        call_table.append(calls.where(part), f"{root}/calls", batch, "s")
        incremental.log(calls.where(part), f"{root}/changes", batch, "s")
        refresh(call_table.read(spark, f"{root}/calls"))
    stored = call_table.read(spark, f"{root}/calls")
    gone = F.dayofmonth("created_at") == 9
    incremental.log(stored.where(gone), f"{root}/changes", 0, "removals")
    last = refresh(stored.where(~gone))
    rows = incremental.read(spark, last).drop(*rollup.SKETCHES, "day")
    floats = [c for c in rows.columns if c.startswith(("p50", "p95", "p99", "total"))]
    return rounded(rows, *floats)


@query
def rollup_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup from partials: two drained runs of a stream, folded, a batch repeated."""
    root = scratch_path(spark, "fresh")
    calls = tables.calls(spark, sf_dir)
    half = F.right("id", F.lit(12)).cast("bigint") % 2
    for part in (0, 1):  # the second run's calls are as old as the first's
        calls.where(half == part).write.mode("append").parquet(f"{root}/feed")
        feed = feeds.stream_files(spark, f"{root}/feed", schema=calls.schema)
        live_rollup.write_fresh(feed, f"{root}/partials", f"{root}/offsets").awaitTermination()
    live_rollup.fold(spark, f"{root}/partials", f"{root}/folded")
    stream = live_load.stream_id(spark, f"{root}/offsets")
    live_rollup.store_partials(calls.where(half == 1), f"{root}/folded", 1, stream)
    rows = live_rollup.fresh(spark, f"{root}/folded").drop(*rollup.SKETCHES)
    return rounded(rows, "total_latency_ms", "total_cost")


@query
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of a stream: in time, or behind the mark and by how much.

    A third of the calls comes after the others and is as old; ten days are allowed.
    """
    root = scratch_path(spark, "late")
    calls = tables.calls(spark, sf_dir).select("id", "created_at")
    third = F.right("id", F.lit(12)).cast("bigint") % 3 == 0

    def keep(rows: DataFrame, batch: int, stream: str) -> None:
        call_table.replace_batch(rows, f"{root}/timely", batch, stream)

    for part in (~third, third):
        calls.where(part).write.mode("append").parquet(f"{root}/feed")
        feed = feeds.stream_files(spark, f"{root}/feed", schema=calls.schema)
        late.split_stream(
            feed, "created_at", "10 DAYS", f"{root}/split", f"{root}/offsets", keep
        ).awaitTermination()
    timely = spark.read.parquet(f"{root}/timely").select(
        "id", F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("late_by_us")
    )
    missed = late.late(spark, f"{root}/split", calls.schema)
    return timely.unionByName(missed.select("id", F.lit(True).alias("late"), "late_by_us"))


# --- pricing and admission -----------------------------------------------------------


@query
def price_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = pricing.flag_missing_cost(pricing.with_cost(tables.calls(spark, sf_dir)))
    return priced.select(
        "id",
        "total_cost",
        "cost_missing",
        member(F.col("metadata"), "cost_missing").alias("flag"),
        member(F.col("metadata"), "k").alias("k"),
    )


@query
def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tables.calls(spark, sf_dir)
    unpriced = validation.refused(calls, catalogs.prices(spark))
    return unpriced.groupBy("provider", "model").agg(F.count("*").alias("n"))


@query
def model_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.requests(spark, sf_dir)
    registry = catalogs.registry(spark)

    def counted(rows: DataFrame, accepted: bool) -> DataFrame:
        totals = rows.groupBy("provider", "model").agg(F.count("*").alias("n"))
        return totals.withColumn("accepted", F.lit(accepted))

    accepted = counted(validation.admitted(requests, registry), True)
    return accepted.unionByName(counted(validation.refused(requests, registry), False))


@query
def call_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = call_table.lookup(tables.calls(spark, sf_dir), CALL)
    return call_table.project(found, "id", "provider", "model", "status", "created_at")


@query
def adhoc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_table.project(tables.calls(spark, sf_dir))


# --- feed: validation, load, maintenance ------------------------------------------------


@query
def validate_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validation.check(tables.feed(spark, sf_dir))
    return validation.good(checked).select("origin_id", "record.*")


def _reasons(dead: DataFrame) -> DataFrame:
    return dead.select("origin_id", F.array_join("errors", ",").alias("errors"))


@query
def validate_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(validation.dead(validation.check(tables.feed(spark, sf_dir))))


@query
def feed_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.counts(validation.check(tables.feed(spark, sf_dir)))


def _good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_load.calls_stream(tables.feed(spark, sf_dir))


@query
def dedupe_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows against a table that already holds the calls of the first week."""
    stored = tables.calls(spark, sf_dir).where("created_at < timestamp_ntz'2024-01-08'")
    rows = loading.new_rows(_good_rows(spark, sf_dir), stored)
    return rows.select("origin_id", *CALL_COLUMNS)


@query
def load_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored previews after the rules and an entity finder, here one that knows a name."""

    def name(text: Column) -> Column:
        at = F.locate("Ada Park", text)
        kind = F.lit("PERSON").alias("type")
        span = F.struct((at - 1).alias("start"), (at + 7).alias("end"), kind)
        return F.when(at > 0, F.array(span))

    good = validation.good(validation.check(tables.feed(spark, sf_dir)))
    return loading.to_calls(good, entities=name).select("origin_id", "id", "input_preview")


def _poisoned_feed(events: DataFrame, poisoned: Column) -> DataFrame:
    """The feed, some previews of which an analyzer will fail on."""
    feed = tables.feed_of(events)
    marked = F.replace("payload", F.lit('"input_preview":"'), F.lit('"input_preview":"POISON '))
    return feed.withColumn("payload", F.when(poisoned, marked).otherwise(F.col("payload")))


def _analyzer():
    """An entity analyzer that knows one name and cannot read some texts."""

    def analyze(text: str) -> list[tuple[int, int, str]]:
        if text.startswith("POISON"):
            raise ValueError(text)
        at = text.find("Ada Park")
        return [(at, at + 8, "PERSON")] if at >= 0 else []

    return analyze


def _isolated(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a streamed load whose guarded plug-in fails on every 101st number."""
    root = scratch_path(spark, "isolated")
    number = F.left("origin_id", F.lit(12)).cast("bigint")
    live_load.load_stream(
        _poisoned_feed(tables.table_stream(spark, sf_dir, "events"), number % 101 == 7),
        f"{root}/calls",
        f"{root}/dead",
        f"{root}/offsets",
        entities=plugins.guarded_span_finder(_analyzer),
    ).awaitTermination()
    return root


@query
def load_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = call_table.read(spark, f"{_isolated(spark, sf_dir)}/calls")
    return stored.select("id", "status", "input_preview", "created_at")


def _letters(spark: SparkSession, path: str) -> DataFrame:
    dead = spark.read.parquet(path)
    return dead.select("origin_id", F.array_join("errors", ",").alias("errors"), "attempts")


@query
def load_isolated_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, f"{_isolated(spark, sf_dir)}/dead")


@query
def load_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every feed row went when two of them make their task fail."""
    root = scratch_path(spark, "halved")
    number = F.left("origin_id", F.lit(12)).cast("bigint")
    feed = _poisoned_feed(tables.table(spark, sf_dir, "events"), number.isin(107, 208))
    live_load.load_batch(
        feed, 0, f"{root}/calls", f"{root}/dead", entities=plugins.span_finder(_analyzer)
    )
    stored = call_table.read(spark, f"{root}/calls").select(
        F.col("id").alias("place"), "input_preview", F.lit(0).alias("attempts")
    )
    dead = _letters(spark, f"{root}/dead").withColumnsRenamed(
        {"origin_id": "place", "errors": "input_preview"}
    )
    return stored.unionByName(dead)


@query
def dedupe_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tables.calls(spark, sf_dir).where("created_at < timestamp_ntz'2024-01-08'")
    return _reasons(loading.duplicates(_good_rows(spark, sf_dir), stored, key=("id",)))


def _spread_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of three months: every third one moved on by 31 and by 62 days."""
    calls = tables.calls(spark, sf_dir)
    third = F.right("id", F.lit(12)).cast("bigint") % 3
    moved = F.timestamp_add("DAY", third * 31, F.col("created_at"))
    return calls.withColumn("created_at", moved)


@query
def month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = loading.months_touched(_spread_calls(spark, sf_dir))
    first = months.agg(F.min("created_month").alias("first"))
    # fourteen months from the first one in the data, and every month the data has
    forward = call_table.months_forward(first, "first", 14)
    every = forward.unionAll(months.select("created_month")).distinct()
    return call_table.month_bounds(every)


@query
def route_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = _spread_calls(spark, sf_dir).select(
        F.col("id").alias("origin_id"),
        F.col("metadata").alias("payload"),
        F.col("created_at").alias("arrived_at"),
        "created_at",
    )
    _, outside = loading.route(arrived, "2024-01-15", 2)
    return _reasons(outside)


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows some load has accounted for: four out of five."""
    feed = tables.feed(spark, sf_dir)
    return feed.where(F.left("origin_id", F.lit(12)).cast("bigint") % 5 != 0).select("origin_id")


@query
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = tables.feed(spark, sf_dir)
    dead = validation.dead(validation.check(feed))
    return feeds.counters(feed, _processed(spark, sf_dir), dead, limit=1000)


@query
def unprocessed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = feeds.unprocessed(
        tables.feed(spark, sf_dir),
        _processed(spark, sf_dir),
        as_of="2024-01-20 00:00:00",
        idle_seconds=60,
    )
    return pending.select("origin_id", "arrived_at")


@query
def replay_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters checked again after the unknown provider was corrected."""
    dead = validation.dead(validation.check(tables.feed(spark, sf_dir)))
    mended = F.replace("payload", F.lit('"provider":"made-up"'), F.lit('"provider":"openai"'))
    return _reasons(loading.replay(dead.withColumn("payload", mended)))


# --- responses and chunks ------------------------------------------------------------------


def _extracted(spark: SparkSession, sf_dir: str, shape: str, *members: str) -> DataFrame:
    rows = responses.extract(tables.responses(spark, sf_dir, shape), shape=shape)
    metadata = F.col("metadata")
    return rows.select(
        "call_id",
        "input_tokens",
        "output_tokens",
        "output_text",
        *[member(metadata, m).alias(m) for m in members],
        F.array_join(F.array_sort(F.json_object_keys(metadata)), ",").alias("members"),
    )


@query
def extract_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "completion", "system_fingerprint", "finish_reason")


@query
def extract_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "messages", "stop_reason", "cache_read_input_tokens")


@query
def extract_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(
        spark, sf_dir, "router", "openrouter_upstream", "openrouter_generation_id"
    )


@query
def assemble_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(tables.chunks(spark, sf_dir, "completion")).drop("stop_reason")


@query
def assemble_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(tables.chunks(spark, sf_dir, "messages"), "messages")


@query
def assemble_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls cut after their fifth chunk keep the text that arrived before."""
    chunks = tables.chunks(spark, sf_dir, "completion")
    cuts = (
        tables.requests(spark, sf_dir)
        .where(F.col("error_type") == "CancelledError")
        .select("call_id", F.lit(4).alias("cut_seq"))
    )
    return assembly.assemble(assembly.until(chunks, cuts)).select("call_id", "text", "n_chunks")


def _outcomes(spark: SparkSession, sf_dir: str, ruleset: str) -> DataFrame:
    found = outcome.classify(F.col("error_type"), F.col("error_message"), ruleset)
    return tables.requests(spark, sf_dir).select("call_id", found.alias("status"))


@query
def outcome_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, "python")


@query
def outcome_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, "web")


@query
def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = records.build(
        tables.requests(spark, sf_dir), tables.chunks(spark, sf_dir, "completion")
    )
    metadata = F.col("metadata")
    return (
        records.valid_only(built)
        .withColumns(
            {m: member(metadata, m) for m in ("turns", "cost_estimated", "cost_missing")}
        )
        .drop("metadata")
    )


@query
def backfill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = assembly.assemble(tables.chunks(spark, sf_dir, "completion"))
    prompts = tables.requests(spark, sf_dir).select("call_id", "prompt")
    filled = assembly.backfill_usage(whole.join(prompts, "call_id"), prompt="prompt")
    return filled.select("call_id", "input_tokens", "output_tokens", "cost_estimated")


@query
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later objects overrule earlier ones and values keep their JSON type."""
    events = tables.table(spark, sf_dir, "events")
    patch = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 2 == 0, F.lit("patched")).alias("k"),
            F.col("event_type").alias("kind"),
        )
    )
    merged = flag_if(
        merge_objects(F.col("props"), patch), "cost_missing", F.col("event_id") % 3 == 0
    )
    return events.select("event_id", merged.alias("m")).select(
        "event_id", *[member(F.col("m"), k).alias(k) for k in ("k", "kind", "cost_missing")]
    )


# --- redaction -----------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over whole texts."""
    whole = redaction.redact(F.col("text"), max_chars=None)
    texts = tables.sensitive_documents(spark, sf_dir)
    return texts.select("doc_id", whole.alias("redacted"))


@query
def redact_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loader stores: the preview is cut first and redacted then."""
    texts = tables.sensitive_documents(spark, sf_dir)
    return texts.select("doc_id", redaction.redact(F.col("text")).alias("redacted"))


@query
def redact_card_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redaction.apply_rules(F.col("text"), [redaction.CARD_RULE])
    return _documents(spark, sf_dir).select("doc_id", masked.alias("redacted"))


@query
def replace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(start: Column, end: Column, kind: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("type"))

    def spans(first_gap: Column) -> Column:
        name = span(F.lit(0), first_gap, "PERSON")
        place = span(first_gap + 3, first_gap + 9, "LOCATION")
        return (
            F.when(F.col("doc_id") % 3 == 0, F.array(place, name))
            .when(F.col("doc_id") % 3 == 1, F.array(name))
            .otherwise(F.array().cast("array<struct<start:int,end:int,type:string>>"))
        )

    found = bind(F.locate(" ", "text"), spans)
    return _documents(spark, sf_dir).select(
        "doc_id", redaction.replace_spans(F.col("text"), found).alias("redacted")
    )


@query
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.report(tables.sensitive_documents(spark, sf_dir), "text")


@query
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.md5("text"))
    return _documents(spark, sf_dir).select("doc_id", redaction.mask_secret(secret).alias("masked"))


@query
def allowlist_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of the model names occurs, and whether it is allowed."""
    calls = tables.calls(spark, sf_dir)
    tokens = F.explode(F.split(F.concat_ws("/", "provider", "model"), "[/.-]"))
    counted = calls.groupBy("provider", "model").agg(F.count("*").alias("n"))
    return (
        counted.select(tokens.alias("token"), "n")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .withColumn("allowed", redaction.is_allowed_token(F.col("token")))
    )


# --- conversation store -------------------------------------------------------------------


def _seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was seen in each conversation: a known name, its capitalised form, or a new one."""
    turns = tables.table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") % 12).cast("string")
    name = F.when(
        F.col("conv_id") % 7 == 0, F.concat(F.lit("User"), number)
    ).otherwise(F.concat(F.lit("  user"), number, F.lit("\t")))
    seen_at = F.timestamp_add("DAY", F.lit(300) + F.col("turn"), F.lit(tables.START).cast("timestamp_ntz"))
    return turns.select(name.alias("username"), seen_at.alias("seen_at"))


@query
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.upsert_users(tables.users(spark, sf_dir), _seen_users(spark, sf_dir))


@query
def users_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chat.upsert_users(tables.users(spark, sf_dir), _seen_users(spark, sf_dir))
    return chat.users_by_name(merged)


@query
def find_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chat.upsert_users(tables.users(spark, sf_dir), _seen_users(spark, sf_dir))
    return chat.find_user(merged, "USER7")


@query
def create_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = tables.sessions(spark, sf_dir).select("id", "user_id", "title", "created_at")
    return chat.create_sessions(wanted)


@query
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as they were created, after all messages were added."""
    created = tables.sessions(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return chat.append_messages(created, tables.messages(spark, sf_dir))


@query
def append_messages_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of messages to add, a third of which break a rule."""
    number = F.right("id", F.lit(12)).cast("bigint")
    robot = F.when(number % 7 == 3, F.lit("robot")).otherwise(F.col("role"))
    stray = F.when(number % 5 == 2, F.lit("nowhere")).otherwise(F.col("session_id"))
    messages = tables.messages(spark, sf_dir).withColumns({"role": robot, "session_id": stray})
    accepted, refused = chat.accepted_messages(messages, tables.sessions(spark, sf_dir))
    reasons = F.array_join("errors", ",").alias("errors")
    return accepted.select(*messages.columns, F.lit("").alias("errors")).unionByName(
        refused.select(*messages.columns, reasons)
    )


@query
def chat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken chat rules per kind of row, on rows made wrong at regular places."""
    odd = F.col("id").substr(36, 1) == "3"
    long = F.col("id").substr(36, 1) == "2"
    messages = tables.messages(spark, sf_dir).withColumns(
        {
            "role": F.when(odd, F.lit("robot")).otherwise(F.col("role")),
            "content": F.when(long, F.repeat(F.lit("x"), 200_001)).otherwise(F.col("content")),
        }
    )
    name = F.col("username")
    users = _seen_users(spark, sf_dir).withColumn(
        "username",
        F.when(name.startswith("User"), F.lit(" "))
        .when(name == "  user1\t", F.repeat(F.lit("u"), 65))
        .otherwise(name),
    )
    sessions = tables.sessions(spark, sf_dir).withColumn(
        "title", F.when(odd, F.repeat(F.lit("x"), 256)).otherwise(F.col("title"))
    )

    def broken(kind: str, checked: DataFrame) -> DataFrame:
        return (
            checked.select(F.lit(kind).alias("kind"), F.explode("errors").alias("rule"))
            .groupBy("kind", "rule")
            .agg(F.count("*").alias("n"))
        )

    return (
        broken("message", validation.check_messages(messages))
        .unionAll(broken("user", validation.check_users(users)))
        .unionAll(broken("session", validation.check_sessions(sessions)))
    )


@query
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, messages = tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir)
    return chat.session_list(sessions, messages, CHAT_USER)


@query
def session_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, messages = tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir)
    return chat.session_lists(sessions, messages)


@query
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, messages = tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir)
    return chat.session_detail(sessions, messages)


@query
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.transcript(
        tables.messages(spark, sf_dir), "00000000-0000-4000-a000-000000000005"
    )


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the model each one talks to."""
    catalog = F.broadcast(catalogs.numbered_prices(spark)).select("entry", "model")
    turns = tables.table(spark, sf_dir, "conversations")
    numbered = turns.withColumn("entry", (F.col("conv_id") % 24).cast("int"))
    return numbered.join(catalog, "entry").drop("entry")


@query
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_window(_turns(spark, sf_dir))


@query
def context_window_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cap of two turns, so that conversations are really cut."""
    return context.context_window(_turns(spark, sf_dir), cap=2)


@query
def context_window_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With caps below the default for two models; the others keep the default."""
    caps = spark.createDataFrame(list(CUSTOM_CAPS.items()), "model string, cap int")
    turns = _turns(spark, sf_dir)
    return context.context_window(turns, caps=caps, max_cap=max(CUSTOM_CAPS.values()))


@query
def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.last_user_message(context.context_window(_turns(spark, sf_dir), cap=2))


@query
def calls_with_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tables.requests(spark, sf_dir).select("call_id", "session_id", "message_id", "model")
    linked = chat.link_calls(
        calls, tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir)
    )
    return linked.select("call_id", "session_id", "user_id", "title", "message_role")


@query
def purge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir)
    doomed = users.where(F.col("username").isin("user2", "user5")).select(
        F.col("id").alias("user_id")
    )
    left = chat.purge_users(
        users, tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir), doomed
    )
    named = zip(("user", "session", "message"), left, strict=True)
    kinds = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in named]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


def _stored_chat(spark: SparkSession, sf_dir: str, sessions: DataFrame) -> chat_store.Store:
    """A fresh conversation store that holds the sample's users and ``sessions``."""
    kept = chat_store.store(scratch_path(spark, "chat"), buckets=8)
    keyed.put(tables.users(spark, sf_dir), kept.users)
    keyed.put(sessions, kept.sessions)
    return kept


@query
def stored_upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored users after two upserts, one of them repeated."""
    kept = _stored_chat(spark, sf_dir, tables.sessions(spark, sf_dir))
    seen = _seen_users(spark, sf_dir)
    even = F.pmod(F.crc32(F.trim(F.col("username")).cast("binary")), F.lit(2)) == 0
    for part in (even, ~even, even):
        chat_store.upsert_users(kept, seen.where(part))
    return keyed.read(spark, kept.users)


@query
def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sessions after their messages were added in three steps, then compacted."""
    created = tables.sessions(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    kept = _stored_chat(spark, sf_dir, created)
    messages = tables.messages(spark, sf_dir)
    turn = F.right("id", F.lit(12)).cast("bigint") % 1000
    for part in (turn < 3, turn >= 3, turn >= 3):  # the last step is repeated
        chat_store.append_messages(kept, messages.where(part))
    keyed.compact(spark, kept.sessions)
    return keyed.read(spark, kept.sessions)


@query
def stored_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation store holds after two users were purged from it."""
    kept = _stored_chat(spark, sf_dir, tables.sessions(spark, sf_dir))
    keyed.put(tables.messages(spark, sf_dir), kept.messages)
    users = tables.users(spark, sf_dir).where(F.col("username").isin("user2", "user5"))
    chat_store.purge_users(kept, users.select(F.col("id").alias("user_id")))
    left = {"user": kept.users, "session": kept.sessions, "message": kept.messages}
    kinds = [
        keyed.read(spark, place).select(F.lit(kind).alias("kind"), "id")
        for kind, place in left.items()
    ]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


# --- streams -----------------------------------------------------------------------------


@query
def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call table after the feed was loaded as a stream."""
    root = scratch_path(spark, "load")
    feed = tables.feed_of(tables.table_stream(spark, sf_dir, "events"))
    live_load.load_stream(
        feed, f"{root}/calls", f"{root}/dead", f"{root}/offsets"
    ).awaitTermination()
    return call_table.read(spark, f"{root}/calls").select(*CALL_COLUMNS)


@query
def stream_load_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call table after two feeds, each with its own checkpoint, and a replay."""
    root = scratch_path(spark, "load")
    for part in range(2):
        events = tables.table_stream(spark, sf_dir, "events").where(F.col("event_id") % 2 == part)
        live_load.load_stream(
            tables.feed_of(events), f"{root}/calls", f"{root}/dead", f"{root}/offsets{part}"
        ).awaitTermination()
    again = loading.retryable(spark.read.parquet(f"{root}/dead"))
    live_load.load_batch(again, 0, f"{root}/calls", f"{root}/dead-again", stream="replay")
    return call_table.read(spark, f"{root}/calls").select(*CALL_COLUMNS)


@query
def replay_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of the letters that are dead again after two replays."""
    root = scratch_path(spark, "replay")
    live_load.load_batch(tables.feed(spark, sf_dir), 0, f"{root}/calls", f"{root}/dead0")
    for n in (1, 2):
        again = loading.retryable(spark.read.parquet(f"{root}/dead{n - 1}"))
        live_load.load_batch(again, n, f"{root}/calls", f"{root}/dead{n}", stream="replay")
    dead = spark.read.parquet(f"{root}/dead2")
    return dead.select("origin_id", F.array_join("errors", ",").alias("errors"), "attempts")


@query
def load_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of calls and letters after a load that stopped between the two.

    The second of three batches wrote its calls, but neither its letters nor its note.
    """
    root = scratch_path(spark, "visible")
    calls, dead, noted = (f"{root}/{part}" for part in ("calls", "dead", "commits"))
    feed = tables.feed(spark, sf_dir)
    third = F.left("origin_id", F.lit(12)).cast("bigint") % 3
    for batch in (0, 2, 2):  # a batch that is noted is left alone
        live_load.load_batch(
            feed.where(third == batch), batch, calls, dead, stream="s", commits_path=noted
        )
    live_load.load_batch(feed.where(third == 1), 1, calls, f"{root}/lost", stream="s")
    done = call_table.commits(spark, noted)
    seen = call_table.visible(call_table.read(spark, calls), done)
    letters = call_table.visible(spark.read.parquet(dead), done)
    return seen.select(F.col("id").alias("place"), F.lit("call").alias("kind")).unionByName(
        letters.select(F.col("origin_id").alias("place"), F.array_join("errors", ",").alias("kind"))
    )


@query
def compacted_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call table after three batches, a copy of it, and the last batch once more."""
    root = scratch_path(spark, "compact")
    events = tables.table(spark, sf_dir, "events")

    def load(batch: int, path: str) -> None:
        # the number an origin id starts with is its event's
        rows = tables.feed_of(events.where(F.col("event_id") % 3 == batch))
        live_load.load_batch(rows, batch, path, f"{root}/dead", stream="s")

    for batch in range(3):
        load(batch, f"{root}/calls")
    call_table.compact(spark, f"{root}/calls", f"{root}/compacted")
    load(2, f"{root}/compacted")
    stored = call_table.read(spark, f"{root}/compacted")
    return stored.select(*CALL_COLUMNS, call_table.STREAM, call_table.BATCH)


@query
def compacted_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table copied in Z-order, with whose rows they are."""
    root = scratch_path(spark, "clustered")
    calls = tables.calls(spark, sf_dir)
    number = F.right("id", F.lit(12)).cast("bigint")
    for batch in range(3):
        call_table.append(calls.where(number % 3 == batch), f"{root}/calls", batch, "s")
    call_table.compact(spark, f"{root}/calls", f"{root}/copy", call_table.CLUSTER_BY)
    copy = call_table.read(spark, f"{root}/copy")
    columns = ("id", "session_id", "model", "created_at", "status", "latency_ms")
    return copy.select(*columns, call_table.STREAM, call_table.BATCH)


@query
def load_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored calls, and letters by their batch, of a load that asks the id index.

    The second batch is the whole feed, so it meets all of the first one's ids again; then
    it is repeated.
    """
    root = scratch_path(spark, "indexed")
    index = id_index.Index(f"{root}/index")
    events = tables.table(spark, sf_dir, "events")
    feed = tables.feed_of(events)
    # the number an origin id starts with is its event's
    third = tables.feed_of(events.where(F.col("event_id") % 3 == 0))
    for batch, rows in ((0, third), (1, feed), (1, feed)):
        live_load.load_batch(
            rows, batch, f"{root}/calls", f"{root}/dead", ("id",), stream="s", index=index
        )
    number = F.col(call_table.BATCH).cast("bigint").alias("batch")
    stored = call_table.read(spark, f"{root}/calls").select(
        F.col("id").alias("place"), F.lit("call").alias("kind"), number
    )
    letters = spark.read.parquet(f"{root}/dead")
    return stored.union(letters.select("origin_id", F.array_join("errors", ","), number))


@query
def call_lookup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_lookup`` on a stored table, by way of an index built afterwards and compacted."""
    root = scratch_path(spark, "lookup")
    calls = tables.calls(spark, sf_dir)
    for batch in range(2):
        half = F.pmod(F.xxhash64("id"), F.lit(2)) == batch
        call_table.append(calls.where(half), f"{root}/calls", batch, "s")
    built = id_index.Index(f"{root}/built", buckets=16)
    id_index.build(spark, f"{root}/calls", built)
    compacted = id_index.compact(spark, built, f"{root}/compacted")
    found = id_index.lookup(spark, f"{root}/calls", compacted, CALL)
    return call_table.project(found, "id", "provider", "model", "status", "created_at")


@query
def stream_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead-letter table after the feed was loaded as a stream."""
    root = scratch_path(spark, "load")
    feed = tables.feed_of(tables.table_stream(spark, sf_dir, "events"))
    live_load.load_stream(
        feed, f"{root}/calls", f"{root}/dead", f"{root}/offsets", key=("id",)
    ).awaitTermination()
    dead = spark.read.parquet(f"{root}/dead")
    return _reasons(dead).join(dead.select("origin_id", "attempts"), "origin_id")


@query
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered calls dropped within the watermark."""
    root = scratch_path(spark, "dedupe")
    feed = tables.feed_of(tables.table_stream(spark, sf_dir, "events"))
    unique = live_load.without_redelivered(live_load.calls_stream(feed))
    live_assembly.write(
        unique.select("id", "created_at", "status"), f"{root}/calls", f"{root}/offsets"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/calls")


@query
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours, once the stream was drained and closed."""
    root = scratch_path(spark, "rollup")

    def drain() -> StructType:
        calls = tables.calls_of(tables.table_stream(spark, sf_dir, "events"))
        rows = live_rollup.rollup_stream(closing.with_marks(calls, f"{root}/marks"))
        live_rollup.write(rows, f"{root}/rollup", f"{root}/offsets").awaitTermination()
        return calls.schema

    closing.mark(spark, drain(), f"{root}/marks", "created_at")
    drain()
    stored = spark.read.parquet(f"{root}/rollup").drop("day", *rollup.SKETCHES)
    return rounded(stored, "total_latency_ms", "total_cost")


@query
def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls, once the stream was drained and closed."""
    root = scratch_path(spark, "assembly")

    def drain() -> StructType:
        conversations = tables.table_stream(spark, sf_dir, "conversations")
        chunks = tables.chunks_of(conversations, "completion")
        rows = live_assembly.assemble_stream(closing.with_marks(chunks, f"{root}/marks"))
        live_assembly.write(rows, f"{root}/calls", f"{root}/offsets").awaitTermination()
        return chunks.schema

    closing.mark(spark, drain(), f"{root}/marks", "ts")
    drain()
    return spark.read.parquet(f"{root}/calls").drop("stop_reason")


@query
def stream_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls emitted by their terminal event, with the start of their text."""
    root = scratch_path(spark, "preview")
    conversations = tables.table_stream(spark, sf_dir, "conversations")
    live = live_assembly.preview_stream(tables.chunks_of(conversations, "messages"), "messages")
    live_assembly.write(live, f"{root}/calls", f"{root}/offsets").awaitTermination()
    return spark.read.parquet(f"{root}/calls")
