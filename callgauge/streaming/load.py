"""Loading the feed, one micro-batch at a time.

Offsets are committed after both tables are written. A batch that is repeated after
a failure replaces exactly what its first attempt wrote, so every row ends up in the
call table or the dead-letter table once. What a batch wrote is known by its stream and
its number; a stream is named by the id its checkpoint holds, so several feeds, restarts
with a new checkpoint, and replays can share the tables.

One bad row must not hold up its batch. A plug-in that reports failures
(``plugins.guarded_span_finder``) turns the rows it fails on into dead letters at the cost of
a column. Rows that make a task fail otherwise are found by halving (``isolate``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.operators import loading, validation
from callgauge.plans import incremental
from callgauge.schema import MAX_LOAD_ATTEMPTS
from callgauge.session import discard, materialize, scratch_path
from callgauge.sources import calls as call_table
from callgauge.sources import id_index
from callgauge.sources.calls import BATCH, MONTH, STREAM

# more distinct months than this in one batch: compare with the whole table instead
MONTHS_TO_PRUNE = 120
# a batch with more rows that fail on their own has another cause than its rows
MAX_ISOLATED = 32
# a part that fails is halved so often at once, and so many parts run side by side
HALVINGS = 4
PROBES = 16
# a task that writes or reads checked rows holds one row group of them
STAGED_BLOCK = 16 << 20
_PART = "_part"


def _stored(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    key: Sequence[str],
    stream: str,
    batch: int,
) -> DataFrame | None:
    """Rows other batches stored that could collide with this one.

    With the instant in the key only the months a batch touches are opened.
    """
    own = (F.col(STREAM) == stream) & (F.col(BATCH) == batch)
    # equal keys have equal instants: per month, only the span the batch covers can
    # collide, and that span reaches the partition filter and the row-group statistics
    spans = []
    if "created_at" in key:
        spans = loading.instants_touched(rows).limit(MONTHS_TO_PRUNE + 1).collect()
    if "created_at" not in key or len(spans) > MONTHS_TO_PRUNE:
        try:
            return call_table.read(spark, path).where(~own)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # nothing has been loaded yet
    months = [s[MONTH] for s in spans if s[MONTH] is not None]
    stored = call_table.read_months(spark, path, months)
    if stored is None:
        return None
    covered = [
        (F.col(MONTH) == s[MONTH]) & F.col("created_at").between(s["first"], s["last"]) for s in spans
    ]
    return stored.where(~own).where(reduce(or_, covered, F.lit(False)))


def load_batch(
    feed: DataFrame,
    batch: int,
    calls_path: str,
    dead_path: str,
    key: Sequence[str] = loading.TABLE_KEY,
    first_month: date | str | None = None,
    months: int = 0,
    stream: str = "direct",
    entities: Callable[[Column], Column] | None = None,
    isolate: int = MAX_ISOLATED,
    changes_path: str | None = None,
    commits_path: str | None = None,
    index: id_index.Index | None = None,
) -> None:
    """Validate, redact, de-duplicate and store one batch; the rest become dead letters.

    A batch replaces what ``stream`` stored under the same number; batches that do not
    come from ``load_stream``, replays above all, name a stream of their own.
    With ``first_month`` and ``months`` only calls of those months are accepted.
    ``entities`` finds entity spans in previews, see ``loading.to_calls``.
    When preparing the rows fails, up to ``isolate`` rows that are to blame become dead
    letters and the rest is loaded; 0 lets the batch fail. With ``changes_path`` the hours
    of the batch are noted for ``plans.incremental``. With ``commits_path`` a batch is noted
    there once all its tables are written, and left alone when it comes again; readers that
    take ``call_table.visible`` see all of a batch or nothing. With ``index`` the ids the batch
    stores are added to it, and a key without the instant is compared with the index instead
    of all months of the table; an index that starts later is made by ``id_index.build``.
    """
    spark = feed.sparkSession
    if commits_path is not None and call_table.is_committed(spark, commits_path, batch, stream):
        return
    if "attempts" not in feed.columns:
        feed = feed.withColumn("attempts", F.lit(0))
    checked = unstaged = validation.check(feed)
    place = scratch_path(spark, "checked")
    try:
        try:
            checked = _staged(unstaged, place)
            rows, refused = _prepared(checked, entities)
        except (PySparkException, Py4JJavaError):
            if not isolate or entities is None:
                raise
            bad = _to_blame(feed, checked, entities, isolate)
            to_blame = F.col("origin_id").isin(bad)  # at most ``isolate`` ids
            # without anyone to blame it was a passing failure
            if checked is unstaged:
                checked = _staged(unstaged, place)
            rows, refused = _prepared(checked.where(~to_blame), entities)
            letters = loading.exhausted(feed.where(to_blame), F.array(F.lit(loading.FAILED)))
            refused.append(letters)
        if first_month is not None:
            rows, outside = loading.route(rows, first_month, months)
            refused.append(outside)
        if index is not None and "created_at" not in key:
            stored = id_index.stored(rows, index, batch, stream)
        else:
            stored = _stored(spark, calls_path, rows, key, stream, batch)
        refused.append(loading.duplicates(rows, stored, key))
        fresh = loading.new_rows(rows, stored, key)
        if index is not None:
            id_index.add(fresh, index, batch, stream)
        call_table.append(fresh, calls_path, batch, stream)
        if changes_path is not None:
            incremental.log(rows, changes_path, batch, stream)
        letters = reduce(DataFrame.unionByName, refused)
        write_dead(letters, dead_path, batch, stream)
        if commits_path is not None:
            call_table.commit(spark, commits_path, batch, stream)
    finally:
        discard(spark, place)


def _staged(checked: DataFrame, path: str) -> DataFrame:
    """The checked rows in files, so that payloads are checked once, whatever a task has of them.

    The object stream of a cache remembers a task's batches until it is reset, beside the
    memory Spark accounts for, and gives out whole partitions with all columns.
    """
    checked.write.mode("overwrite").option("parquet.block.size", STAGED_BLOCK).parquet(path)
    return checked.sparkSession.read.schema(checked.schema).parquet(path)


def _prepared(
    checked: DataFrame, entities: Callable[[Column], Column] | None
) -> tuple[DataFrame, list[DataFrame]]:
    """(rows to store, dead letters so far).

    Entity models run once per row: what they gave is kept, so that no row is a call in one
    place and a letter in another, whatever a model does when it is asked again.
    """
    good, dead = validation.split(checked)
    rows = loading.to_calls(good, entities=entities)
    if entities is None:
        return rows, [dead]
    rows = materialize(rows)
    if loading.FAILURES not in rows.columns:
        return rows, [dead]
    rows, letters = loading.failed(rows)
    return rows, [dead, letters]


def _probe(feed: DataFrame, entities: Callable[[Column], Column] | None) -> None:
    rows = loading.to_calls(validation.good(validation.check(feed)), entities=entities)
    _run(rows)


def _run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def _to_blame(
    feed: DataFrame,
    checked: DataFrame,
    entities: Callable[[Column], Column] | None,
    isolate: int,
) -> list[str]:
    """The origin ids of the rows that make preparing the batch fail.

    Checking and the rules are done once; where they pass, only the entity step is asked
    again, on the previews the rules left.
    """
    try:
        if entities is None:
            raise ValueError("the entity step is not to blame")
        ruled = loading.to_calls(validation.good(checked))
        previews = materialize(ruled.select("origin_id", *loading.PREVIEWS))
    except (PySparkException, Py4JJavaError, ValueError):
        return failing(feed, lambda part: _probe(part, entities), isolate)
    return failing(previews, lambda part: _run(loading.mask_entities(part, entities)), isolate)


def failing(
    feed: DataFrame,
    attempt: Callable[[DataFrame], None],
    most: int = MAX_ISOLATED,
    attempts: int = MAX_LOAD_ATTEMPTS,
) -> list[str]:
    """The origin ids whose rows make ``attempt`` fail even alone, each time of ``attempts``.

    Parts that fail are halved by a hash of the id, ``HALVINGS`` times at once, and stored by
    what came of it, so that a run reads its own part only; ``PROBES`` parts run side by side.
    Each bad row costs about ``2 ** HALVINGS`` runs of shrinking size for every ``HALVINGS``
    bits of the batch's count. The parts met last go first: beyond ``most`` bad rows the last
    failure is raised soon, then the batch is not held up by single rows.
    """
    spark = feed.sparkSession
    root = scratch_path(spark, "halves")

    def halved(part: DataFrame, bits: int, name: str) -> list[tuple[DataFrame, int, str]]:
        hashed = F.shiftright(F.xxhash64("origin_id"), bits).bitwiseAND((1 << HALVINGS) - 1)
        dealt = part.withColumn(_PART, hashed.cast("int")).hint("rebalance", _PART)
        dealt.write.partitionBy(_PART).parquet(f"{root}/{name}")
        stored = spark.read.parquet(f"{root}/{name}")
        values = sorted(r[_PART] for r in stored.select(_PART).distinct().collect())
        return [
            (stored.where(F.col(_PART) == v).drop(_PART), bits + HALVINGS, f"{name}-{v}")
            for v in values
        ]

    def probe(found: tuple[DataFrame, int, str]) -> tuple[list, list[str], Exception | None]:
        """(parts of a part that fails, its id if it has but one, the failure)"""
        part, bits, name = found
        error = _failure(attempt, part)
        if error is None:
            return [], [], None
        ids = [r.origin_id for r in part.select("origin_id").distinct().limit(2).collect()]
        if len(ids) > 1:
            return halved(part, bits, name), [], error
        again = all(_failure(attempt, part) for _ in range(attempts - 1))
        return [], ids if again else [], error

    bad: list[str] = []
    waiting = halved(feed, 0, "all")
    while waiting:
        asked, waiting = waiting[-PROBES:], waiting[:-PROBES]
        with ThreadPoolExecutor(PROBES) as pool:
            answers = list(pool.map(inheritable_thread_target(spark)(probe), asked))
        for parts, ids, error in answers:
            waiting += parts
            bad += ids
            if len(bad) > most:
                raise error
    return bad


def _failure(attempt: Callable[[DataFrame], None], part: DataFrame) -> Exception | None:
    try:
        attempt(part)
    except (PySparkException, Py4JJavaError) as error:
        return error
    return None


def write_dead(letters: DataFrame, path: str, batch: int, stream: str) -> None:
    """Store a batch's dead letters, with one more attempt on their count."""
    (
        # few files, however many tasks the letters come from
        letters.hint("rebalance")
        .withColumn("attempts", F.col("attempts") + 1)
        .withColumn(STREAM, F.lit(stream))
        .withColumn(BATCH, F.lit(batch).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(STREAM, BATCH)
        .parquet(path)
    )


def load_stream(
    feed: DataFrame,
    calls_path: str,
    dead_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run ``load_batch`` on every micro-batch of a streaming feed.

    ``trigger`` is passed to ``DataStreamWriter.trigger``; the default drains what is
    there and stops. The size of a batch is set on the source (``max_files`` /
    ``max_offsets``).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        load_batch(batch, batch_id, calls_path, dead_path, stream=stream, **options)

    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a started stream keeps in its checkpoint; restarts keep it."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def calls_stream(feed: DataFrame) -> DataFrame:
    """Valid, redacted calls of a streaming feed, for further streaming operators."""
    return loading.to_calls(validation.good(validation.check(feed)))


def without_redelivered(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated ids that arrive within ``delay`` of each other (event time).

    State is bounded by the delay. Repeats further apart are caught when the row is
    compared with the stored table. A call later than the delay is dropped, repeated or
    not: this is for consumers that can do without it. ``load_stream`` has no watermark
    and stores every late call.
    """
    timed = calls.withColumn("created_at", F.col("created_at").cast("timestamp"))
    unique = timed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return unique.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
