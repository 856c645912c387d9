"""The domain tables, derived from the sample tables.

``events`` stands in for calls and feed payloads, ``conversations`` for sessions,
messages and streamed chunks, ``documents`` for texts. Every derivation is a
deterministic function of the rows, so it can be stated in SQL as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators.pricing import call_cost
from callgauge.operators.validation import INT_MAX
from callgauge.schema import CALL_COLUMNS, PRICES
from callgauge.session import spread
from callgauge.sources import catalogs
from callgauge.sources.feed import stream_files

AS_OF = "2024-01-31 00:00:00"
UNLISTED = ("openai", "unlisted-model")
ENTRIES = len(PRICES) + 1
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    # a file source wants a directory or a pattern; this pattern matches the table
    # whether it is one file or a directory of files
    return stream_files(spark, f"{sf_dir}/{name}.parque[t]", schema=schema)


def uuid_of(group: str, number: Column) -> Column:
    """A UUID-shaped id whose last twelve digits are the number."""
    return F.concat(
        F.lit(f"00000000-0000-4000-{group}-"), F.lpad(number.cast("string"), 12, "0")
    )


def calls_of(events: DataFrame) -> DataFrame:
    """Stored calls, one per event; previews are left NULL."""
    catalog = F.broadcast(catalogs.numbered_prices(events.sparkSession))
    tokens = events.selectExpr(
        "*",
        f"CAST(event_id % {ENTRIES} AS INT) AS entry",
        "CAST(get_json_object(props, '$.k') AS INT) AS input_tokens",
        "CAST(event_id * 7 % 500 AS INT) AS output_tokens",
    )
    priced = tokens.join(catalog, "entry", "left").withColumn(
        "cost", call_cost(*map(F.col, ("input_tokens", "output_tokens", "input_per_1k", "output_per_1k")))
    )
    return priced.selectExpr(
        "'00000000-0000-4000-8000-' || lpad(event_id, 12, '0') AS id",
        "CAST(NULL AS STRING) AS message_id",
        "'00000000-0000-4000-9000-' || lpad(user_id, 12, '0') AS session_id",
        f"coalesce(provider, '{UNLISTED[0]}') AS provider",
        f"coalesce(model, '{UNLISTED[1]}') AS model",
        """CASE WHEN event_type <> 'error' THEN 'SUCCESS'
                ELSE element_at(array('ERROR', 'RATE_LIMITED', 'CANCELLED'),
                                CAST(event_id % 3 AS INT) + 1) END AS status""",
        "value * 10 AS latency_ms",
        "CASE WHEN event_type <> 'view' THEN value * 2 END AS ttft_ms",
        "input_tokens",
        "output_tokens",
        "coalesce(cost, 0D) AS total_cost",
        "CAST(NULL AS STRING) AS error_stack",
        "CAST(NULL AS STRING) AS input_preview",
        "CAST(NULL AS STRING) AS output_preview",
        "ts AS created_at",
        "props AS metadata",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose input preview is the beginning of a document."""
    documents = table(spark, sf_dir, "documents")
    size = documents.agg((F.max("doc_id") + 1).alias("n_docs"))
    events = table(spark, sf_dir, "events")
    keyed = calls_of(events).withColumn("event_id", F.right("id", F.lit(12)).cast("bigint"))
    # one number, read from the documents' statistics
    n_docs = size.first()["n_docs"]
    texts = documents.select(
        F.col("doc_id"), F.left("text", F.lit(500)).alias("document_preview")
    )
    joined = keyed.withColumn("doc_id", F.col("event_id") % n_docs).join(texts, "doc_id", "left")
    return joined.withColumn("input_preview", F.col("document_preview")).select(*CALL_COLUMNS)


# --- the telemetry feed ------------------------------------------------------------

BREAK_EVERY = 17

# every way a payload can be wrong: (members to put in, as JSON; members to leave out)
FLAWS = (
    ("", ""),  # no JSON at all
    ("", "latency_ms"),
    ('"provider":"made-up"', "provider"),
    ('"latency_ms":-5', "latency_ms"),
    ('"surprise":1', ""),
    ('"log_id":"not-a-uuid"', "log_id"),
    ('"timestamp":"yesterday"', "timestamp"),
    ("", "log_id"),
    ("", "session_id"),
    ("", "provider"),
    ("", "model"),
    ("", "request_status"),
    ("", "input_tokens"),
    ("", "output_tokens"),
    ("", "total_cost"),
    ("", "timestamp"),
    ('"session_id":"7"', "session_id"),
    ('"message_id":"none"', ""),
    ('"message_id":7', ""),
    ('"model":""', "model"),
    (f'"model":"{"m" * 101}"', "model"),
    ('"model":4', "model"),
    ('"request_status":"MAYBE"', "request_status"),
    ('"latency_ms":"slow"', "latency_ms"),
    ('"latency_ms":null', "latency_ms"),
    ('"ttft_ms":-1', "ttft_ms"),
    ('"ttft_ms":"soon"', "ttft_ms"),
    ('"input_tokens":-1', "input_tokens"),
    ('"input_tokens":2147483648', "input_tokens"),
    ('"input_tokens":1.5', "input_tokens"),
    ('"output_tokens":-1', "output_tokens"),
    ('"output_tokens":0.5', "output_tokens"),
    ('"total_cost":-0.1', "total_cost"),
    ('"error_stack":[]', ""),
    (f'"input_preview":"{"p" * 501}"', "input_preview"),
    (f'"output_preview":"{"p" * 501}"', ""),
    ('"output_preview":5', ""),
    ('"metadata":null', "metadata"),
    ('"metadata":[1]', "metadata"),
    ('"surprise":1,"latency_ms":-5', "latency_ms"),
    ('"provider":"nobody"', "provider|model"),
    ('"input_preview":5', "input_preview"),
    ('"total_cost":"free"', "total_cost"),
    ('"input_tokens":"few"', "input_tokens"),
    ('"output_tokens":"few"', "output_tokens"),
    ('"log_id":null', "log_id"),
    ('"session_id":null', "session_id"),
    ('"provider":null', "provider"),
    ('"request_status":null', "request_status"),
    ('"timestamp":null', "timestamp"),
)
# what previews say, in turn; the redaction rules find something in each of them
PREVIEW_TEXTS = (
    "'mail user' || number || '@example.test from 10.0.0.1'",
    "'Ada Park paid with 4111 1111 1111 1111'",
    "'key sk-' || md5(CAST(number AS STRING)) || ' of 123-45-6789'",
    "'Ada Park came from 2001:db8:0:0:0:0:2:1'",
)


def _in_turn(number: str, choices: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices))
    return f"CASE {number} % {len(choices)} {whens} END"


def _broken(payload: Column, flaw: Column) -> Column:
    """The payload with one of ``FLAWS``."""
    added = F.get(F.array(*[F.lit(f"{new}," if new else "") for new, _ in FLAWS]), flaw)
    value = r'("[^"]*"|\{[^}]*\}|[^,}]*)'
    names = [f'"({gone})":{value},?' if gone else "^$" for _, gone in FLAWS]
    left = F.regexp_replace(payload, F.get(F.array(*map(F.lit, names)), flaw), F.lit(""))
    whole = F.concat(F.lit("{"), added, F.substring(left, 2, INT_MAX))
    closed = F.replace(whole, F.lit(",}"), F.lit("}"))
    return F.when(flaw == 0, F.lit("not-json-at-all")).otherwise(closed)


def feed_of(events: DataFrame) -> DataFrame:
    """Feed rows: every event once, every tenth of them delivered twice.

    Every 17th payload is broken, in one of the ways of ``FLAWS`` in turn.
    """
    # a payload is ten times its event, and checking it costs more than reading it
    numbered = calls_of(spread(events)).selectExpr("*", "CAST(right(id, 12) AS BIGINT) AS number")
    flawed = numbered.selectExpr(
        "*",
        f"""CASE WHEN number % {BREAK_EVERY} = 0
                 THEN CAST(number DIV {BREAK_EVERY} % {len(FLAWS)} AS INT) END AS flaw""",
    )
    written = flawed.selectExpr(
        "number",
        "created_at",
        "flaw",
        f"""to_json(named_struct(
             'log_id', id,
             'session_id', session_id,
             'provider', provider,
             'model', model,
             'request_status', status,
             'latency_ms', latency_ms,
             'ttft_ms', ttft_ms,
             'input_tokens', input_tokens,
             'output_tokens', output_tokens,
             'total_cost', total_cost,
             'input_preview', {_in_turn("number", PREVIEW_TEXTS)},
             'timestamp', date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
             'metadata', parse_json(metadata))) AS payload""",
        "CASE WHEN number % 10 = 3 THEN array(0, 1) ELSE array(0) END AS copies",
    )
    payload, flaw = F.col("payload"), F.col("flaw")
    mixed = written.withColumn(
        "payload", F.when(flaw.isNull(), payload).otherwise(_broken(payload, flaw))
    )
    return mixed.withColumn("copy", F.explode("copies")).selectExpr(
        "lpad(number, 12, '0') || '-' || copy AS origin_id",
        "payload",
        "created_at + make_dt_interval(0, 0, 0, copy * 30) AS arrived_at",
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_of(table(spark, sf_dir, "events"))


# personal data put in front of the documents, in turn; the texts seldom have such
SENSITIVE = (
    "''",
    "'key sk-' || md5(CAST(doc_id AS STRING)) || ' '",
    "'ssn 1' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || '-45-6789 '",
    "'from 2001:db8:0:0:0:0:2:' || CAST(doc_id % 100 AS STRING) || ' '",
    "'id AKIA' || upper(left(md5(CAST(doc_id AS STRING)), 16)) || ' '",
)


def sensitive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four in five with a key, a number or an address in front."""
    prefix = _in_turn("doc_id", SENSITIVE)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{prefix} || text AS text")


# --- the conversation store -----------------------------------------------------------


def _at(*, hours: Column, minutes: Column) -> Column:
    """An instant counted from the start of 2024; hours may be any whole number."""
    return F.timestamp_add(
        "MINUTE", hours.cast("bigint") * 60 + minutes.cast("bigint"), F.lit(START).cast("timestamp_ntz")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        uuid_of("b000", F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        uuid_of("a000", F.col("conv_id")).alias("session_id"),
        "role",
        F.col("text").alias("content"),
        _at(hours=F.col("conv_id"), minutes=F.col("turn")).alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation, and one that never got a message per 25 of them."""
    conversations = table(spark, sf_dir, "conversations")
    used = conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    silent = F.when(
        F.col("conv_id") % 25 == 0, F.array(F.lit(False), F.lit(True))
    ).otherwise(F.array(F.lit(False)))
    rows = used.withColumn("silent", F.explode(silent))
    number = F.col("conv_id") + F.when(F.col("silent"), F.lit(500_000_000)).otherwise(F.lit(0))
    created = _at(hours=F.col("conv_id"), minutes=F.lit(0))
    return rows.select(
        uuid_of("a000", number).alias("id"),
        uuid_of("c000", F.col("conv_id") % 10).alias("user_id"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Session "), F.col("conv_id"))).alias(
            "title"
        ),
        created.alias("created_at"),
        F.when(F.col("silent"), created)
        .otherwise(_at(hours=F.col("conv_id"), minutes=F.col("last_turn")))
        .alias("updated_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that own sessions: user0 .. user9 in the sample."""
    conversations = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") % 10
    return (
        conversations.groupBy(number.alias("number"))
        .agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
        .select(
            uuid_of("c000", F.col("number")).alias("id"),
            F.concat(F.lit("user"), F.col("number")).alias("username"),
            _at(hours=F.col("first"), minutes=F.lit(0)).alias("created_at"),
            _at(hours=F.col("last"), minutes=F.lit(0)).alias("last_seen_at"),
        )
    )


# --- provider responses and streamed chunks -----------------------------------------------


def assistant_turns_of(conversations: DataFrame) -> DataFrame:
    turns = conversations.where(F.col("role") == "assistant")
    return turns.withColumn("number", F.col("conv_id") * 1000 + F.col("turn"))


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant_turns_of(table(spark, sf_dir, "conversations"))


def responses(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """One response document per assistant turn: (call_id, response)."""
    turns = assistant_turns(spark, sf_dir)
    number, text = F.col("number"), F.col("text")
    used = number % 4 != 3
    if shape == "messages":
        half = (F.length(text) / 2).cast("int")
        body = F.struct(
            F.lit("end_turn").alias("stop_reason"),
            F.when(
                used,
                F.struct(
                    (number % 100).alias("input_tokens"),
                    F.length(text).alias("output_tokens"),
                    F.when(number % 2 == 0, number % 7).alias("cache_read_input_tokens"),
                ),
            ).alias("usage"),
            F.array(
                F.struct(
                    F.lit("text").alias("type"), F.substring(text, F.lit(1), half).alias("text")
                ),
                F.struct(F.lit("tool_use").alias("type"), F.lit("hidden").alias("text")),
                F.struct(
                    F.lit("text").alias("type"),
                    F.substring(text, half + 1, F.length(text)).alias("text"),
                ),
            ).alias("content"),
        )
    else:
        answer = F.struct(
            F.lit("stop").alias("finish_reason"), F.struct(text.alias("content")).alias("message")
        )
        body = F.struct(
            F.when(number % 3 != 0, F.concat(F.lit("gen-"), number)).alias("id"),
            F.when(number % 2 == 0, F.lit("Anthropic")).otherwise(F.lit("")).alias("provider"),
            F.when(number % 5 == 0, F.concat(F.lit("fp-"), number % 11)).alias(
                "system_fingerprint"
            ),
            F.when(
                used,
                F.struct(
                    (number % 100).alias("prompt_tokens"),
                    F.length(text).alias("completion_tokens"),
                ),
            ).alias("usage"),
            F.when(number % 13 != 0, F.array(answer)).otherwise(F.array()).alias("choices"),
        )
    return turns.select(uuid_of("b000", number).alias("call_id"), F.to_json(body).alias("response"))


def _pieces(text: Column) -> Column:
    """The words of a text, each but the first with its leading space."""
    words = F.split(text, " ", -1)
    return F.transform(
        words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w))
    )


def _chunk_rows(turns: DataFrame, documents: Column) -> DataFrame:
    """Number a call's chunk documents and stamp them 20 ms apart."""
    exploded = turns.select(
        uuid_of("b000", F.col("number")).alias("call_id"),
        _at(hours=F.col("conv_id"), minutes=F.col("turn")).alias("started_at"),
        F.posexplode(documents).alias("seq", "chunk"),
    )
    return exploded.select(
        "call_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.timestamp_add("MILLISECOND", (F.col("seq") + 1) * 20, F.col("started_at")).alias("ts"),
        "chunk",
    )


def chunks(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    return chunks_of(table(spark, sf_dir, "conversations"), shape)


def chunks_of(conversations: DataFrame, shape: str) -> DataFrame:
    """Streamed chunks of every assistant turn, one word each.

    The first chunk has no text. Turns with an even number end with their usage;
    the others (completion shape) never report any.
    """
    turns = assistant_turns_of(conversations)
    number, text = F.col("number"), F.col("text")
    even = number % 2 == 0
    if shape == "messages":
        def event(**fields: Column) -> Column:
            return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

        start = event(
            type=F.lit("message_start"),
            message=F.struct(F.struct((number % 100).alias("input_tokens")).alias("usage")),
        )
        words = F.transform(
            _pieces(text),
            lambda w: F.to_json(
                F.struct(
                    F.lit("content_block_delta").alias("type"),
                    F.struct(F.lit("text_delta").alias("type"), w.alias("text")).alias("delta"),
                )
            ),
        )
        end = event(
            type=F.lit("message_delta"),
            delta=F.struct(F.when(even, F.lit("end_turn")).alias("stop_reason")),
            usage=F.when(even, F.struct(F.length(text).alias("output_tokens"))),
        )
        stop = event(type=F.lit("message_stop"))
        documents = F.concat(F.array(start), words, F.array(end, stop))
        return _chunk_rows(turns, documents)

    def chunk(content: Column) -> Column:
        delta = F.struct(content.alias("content"))
        return F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices")))

    def usage_chunk(prompt: Column, completion: Column) -> Column:
        usage = F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"))
        return F.to_json(F.struct(F.array().alias("choices"), usage.alias("usage")))

    words = F.transform(_pieces(text), chunk)
    early = usage_chunk(F.lit(1), F.lit(1))
    final = usage_chunk(number % 100, F.length(text))
    # an early usage chunk is there to be overruled by the final one
    documents = F.concat(
        F.array(chunk(F.lit(""))),
        F.when(even, F.array(early)).otherwise(F.array().cast("array<string>")),
        words,
        F.when(even, F.array(final)).otherwise(F.array().cast("array<string>")),
    )
    return _chunk_rows(turns, documents)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request behind every assistant turn; some failed in different ways."""
    turns = assistant_turns(spark, sf_dir)
    number = F.col("number")
    catalog = F.broadcast(catalogs.numbered_prices(spark)).select("entry", "provider", "model")
    fate = number % 10
    error_type = (
        F.when(fate == 1, F.lit("CancelledError"))
        .when(fate == 2, F.lit("RateLimitError"))
        .when(fate == 3, F.lit("HTTPError"))
        .when(fate == 4, F.lit("RuntimeError"))
        .when(fate == 5, F.lit("AbortError"))
        .when(fate == 6, F.lit("Error"))
    )
    error_message = (
        F.when(fate == 1, F.lit(""))
        .when(fate == 2, F.lit("slow down"))
        .when(fate == 3, F.lit("HTTP 429"))
        .when(fate == 4, F.lit("boom"))
        .when(fate == 5, F.lit(""))
        .when(fate == 6, F.lit("The user cancelled it"))
    )
    started = _at(hours=F.col("conv_id"), minutes=F.col("turn"))
    return (
        turns.withColumn("entry", (number % ENTRIES).cast("int"))
        .join(catalog, "entry", "left")
        .select(
            uuid_of("b000", number).alias("call_id"),
            uuid_of("a000", F.col("conv_id")).alias("session_id"),
            uuid_of("b000", number).alias("message_id"),
            F.coalesce("provider", F.lit(UNLISTED[0])).alias("provider"),
            F.coalesce("model", F.lit(UNLISTED[1])).alias("model"),
            started.alias("started_at"),
            F.timestamp_add("MICROSECOND", F.length("text") * 1500 + 500, started).alias("ended_at"),
            error_type.alias("error_type"),
            error_message.alias("error_message"),
            error_type.alias("error_stack"),
            F.concat(F.lit("turn "), F.col("turn"), F.lit(" please")).alias("prompt"),
            F.to_json(F.struct(F.col("turn").alias("turns"))).alias("metadata"),
        )
    )


