"""The result of every query, stated independently in DuckDB SQL.

The SQL computes what each operator should return straight from the sample tables;
it shares the fixed values (prices, patterns, names) with the library, not its logic.
"""

from __future__ import annotations

from callgauge.functions.redaction import RULES
from callgauge.schema import ALLOWED_TOKENS, MODEL_REGISTRY, PRICES, TURN_CAPS

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- domain tables ---------------------------------------------------------------------

PRICE_ROWS = ", ".join(
    f"({i}, {_text(p)}, {_text(m)}, {a!r}::DOUBLE, {b!r}::DOUBLE)"
    for i, (p, m, a, b) in enumerate(PRICES)
)
REGISTRY_ROWS = ", ".join(
    f"({_text(p)}, {_text(m)})" for p, models in MODEL_REGISTRY.items() for m in models
)
CAP_ROWS = ", ".join(f"({_text(m)}, {cap})" for m, cap in TURN_CAPS.items())

PRICE_CTE = f"prices(entry, provider, model, p_in, p_out) AS (VALUES {PRICE_ROWS})"

CALLS = f"""
{PRICE_CTE},
calls AS (
  SELECT e.event_id,
         '00000000-0000-4000-8000-' || lpad(e.event_id::VARCHAR, 12, '0') AS id,
         '00000000-0000-4000-9000-' || lpad(e.user_id::VARCHAR, 12, '0') AS session_id,
         coalesce(p.provider, 'openai') AS provider,
         coalesce(p.model, 'unlisted-model') AS model,
         CASE WHEN e.event_type <> 'error' THEN 'SUCCESS'
              WHEN e.event_id % 3 = 0 THEN 'ERROR'
              WHEN e.event_id % 3 = 1 THEN 'RATE_LIMITED'
              ELSE 'CANCELLED' END AS status,
         e.value * 10 AS latency_ms,
         CASE WHEN e.event_type <> 'view' THEN e.value * 2 END AS ttft_ms,
         json_extract_string(e.props, '$.k')::INTEGER AS input_tokens,
         (e.event_id * 7 % 500)::INTEGER AS output_tokens,
         p.entry IS NULL AS cost_missing,
         coalesce(round(json_extract_string(e.props, '$.k')::INTEGER / 1000.0::DOUBLE * p.p_in
                        + (e.event_id * 7 % 500) / 1000.0::DOUBLE * p.p_out, 8), 0.0) AS total_cost,
         e.ts AS created_at,
         e.props AS metadata
  FROM events e LEFT JOIN prices p ON p.entry = e.event_id % {len(PRICES) + 1}
)"""

RECENT = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR"


def _quantiles(measure: str, suffix: str) -> str:
    return ", ".join(
        f"round(quantile_cont({measure}, {p}), 6) AS {name}_{suffix}"
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )


ORACLES["latency_percentiles"] = f"""
WITH {CALLS}
SELECT provider, model, count(*) AS n,
       {_quantiles("latency_ms", "latency")}, {_quantiles("ttft_ms", "ttft")}
FROM calls WHERE {RECENT} AND status = 'SUCCESS' GROUP BY provider, model"""

ORACLES["throughput"] = f"""
WITH {CALLS}
SELECT provider, model, count(*) AS n, sum(output_tokens)::BIGINT AS total_output_tokens,
       round(sum(latency_ms) / 1000.0, 6) AS total_latency_s,
       round(CASE WHEN sum(latency_ms) > 0
                  THEN sum(output_tokens)::DOUBLE / (sum(latency_ms) / 1000.0)
                  ELSE 0 END, 6) AS tokens_per_second
FROM calls WHERE {RECENT} AND status = 'SUCCESS' GROUP BY provider, model"""

ORACLES["status_by_hour"] = f"""
WITH {CALLS}
SELECT date_trunc('hour', created_at) AS hour, status, count(*) AS n
FROM calls WHERE {RECENT} GROUP BY 1, 2"""

ORACLES["cost_by_day"] = f"""
WITH {CALLS}
SELECT created_at::DATE AS day, provider, model,
       round(coalesce(sum(total_cost), 0), 9) AS cost_usd, count(*) AS n
FROM calls WHERE {RECENT} GROUP BY 1, 2, 3"""

ORACLES["session_activity"] = f"""
WITH {CALLS}
SELECT session_id, count(*) AS n, min(created_at) AS started_at, max(created_at) AS last_at,
       round(sum(total_cost), 9) AS cost_usd
FROM calls GROUP BY session_id ORDER BY last_at DESC, session_id LIMIT 50"""

ORACLES["session_calls"] = f"""
WITH {CALLS}, size AS (SELECT max(doc_id) + 1 AS n_docs FROM documents)
SELECT id, provider, model, status, latency_ms, ttft_ms, input_tokens, output_tokens, total_cost,
       created_at, left(d.text, 500) AS input_preview, NULL::VARCHAR AS output_preview
FROM calls CROSS JOIN size LEFT JOIN documents d ON d.doc_id = event_id % n_docs
WHERE session_id = '00000000-0000-4000-9000-000000000007'"""

ORACLES["dashboard_kpis"] = f"""
WITH {CALLS},
lat AS (SELECT model, count(*) AS n FROM calls WHERE {RECENT} AND status = 'SUCCESS' GROUP BY model),
err AS (SELECT count(*) AS n FROM calls WHERE {RECENT} AND status <> 'SUCCESS'),
cost AS (SELECT coalesce(sum(total_cost), 0) AS usd FROM calls WHERE {RECENT}),
k AS (SELECT coalesce(sum(lat.n), 0)::BIGINT AS calls, count(*) AS models_active FROM lat)
SELECT k.calls, err.n AS errors,
       round(CASE WHEN k.calls > 0 THEN err.n * 100.0::DOUBLE / (k.calls + err.n) ELSE 0 END, 6)
         AS error_rate_pct,
       round(CASE WHEN k.calls + err.n > 0 THEN err.n * 100.0::DOUBLE / (k.calls + err.n) ELSE 0 END,
             6) AS error_rate_all_pct,
       round(cost.usd, 9) AS cost_usd, k.models_active
FROM k, err, cost"""

HOURLY = f"""
SELECT date_trunc('hour', created_at) AS hour, provider, model, status, count(*) AS n,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       round(sum(latency_ms), 6) AS total_latency_ms, round(sum(total_cost), 9) AS total_cost,
       {_quantiles("latency_ms", "latency_ms")}, {_quantiles("ttft_ms", "ttft_ms")}"""

ORACLES["hourly_rollup"] = f"WITH {CALLS} {HOURLY} FROM calls WHERE {RECENT} GROUP BY 1, 2, 3, 4"

ORACLES["rollup_refresh"] = f"""
WITH {CALLS} {HOURLY}, TIMESTAMP '2024-01-31' AS refreshed_at
FROM calls WHERE {RECENT} GROUP BY 1, 2, 3, 4"""

ORACLES["rollup_refresh_removed"] = f"""
WITH {CALLS} {HOURLY}, TIMESTAMP '2024-01-31' AS refreshed_at
FROM calls WHERE {RECENT} AND day(created_at) % 3 <> 0 GROUP BY 1, 2, 3, 4"""

# the refresh that last saw a change in the hour
ORACLES["rollup_incremental"] = f"""
WITH {CALLS},
versions AS (
  SELECT date_trunc('hour', created_at) AS hour,
         max(CASE WHEN created_at >= TIMESTAMP '2024-01-25' THEN 2
                  WHEN event_id % 50 = 7 THEN 3 ELSE 1 END)::INTEGER AS version
  FROM calls GROUP BY 1
),
found AS ({HOURLY} FROM calls WHERE {RECENT} AND day(created_at) <> 9 GROUP BY 1, 2, 3, 4)
SELECT found.*, version FROM found JOIN versions ON versions.hour = found.hour"""

ORACLES["rollup_fresh"] = f"""
WITH {CALLS}
SELECT date_trunc('hour', created_at) AS hour, provider, model, status, count(*) AS n,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       round(sum(latency_ms), 6) AS total_latency_ms, round(sum(total_cost), 9) AS total_cost
FROM calls GROUP BY 1, 2, 3, 4"""

ORACLES["late_rows"] = f"""
WITH {CALLS},
mark AS (
  SELECT max(created_at) - INTERVAL 10 DAY AS watermark FROM calls WHERE event_id % 3 <> 0
),
told AS (SELECT *, event_id % 3 = 0 AND created_at < watermark AS late FROM calls, mark)
SELECT id, late,
       CASE WHEN late THEN date_diff('microsecond', created_at, watermark) END AS late_by_us
FROM told"""

ORACLES["rollup_daily"] = f"""
WITH {CALLS}
SELECT date_trunc('day', created_at)::TIMESTAMP AS day, provider, model, status, count(*) AS n,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       round(sum(latency_ms), 6) AS total_latency_ms, round(sum(total_cost), 9) AS total_cost
FROM calls WHERE {RECENT} GROUP BY 1, 2, 3, 4"""

ORACLES["rollup_daily_exact"] = f"""
WITH {CALLS}
SELECT date_trunc('day', created_at)::TIMESTAMP AS day, provider, model, status,
       count(latency_ms) AS n_latency_ms, count(ttft_ms) AS n_ttft_ms,
       {_quantiles("latency_ms", "latency_ms")}, {_quantiles("ttft_ms", "ttft_ms")}
FROM calls GROUP BY 1, 2, 3, 4"""

ORACLES["rollup_sketch_ranks"] = f"""
WITH {CALLS}
SELECT date_trunc('day', created_at)::TIMESTAMP AS day, provider, model, status,
       count(latency_ms) AS n_latency, count(ttft_ms) AS n_ttft,
       {", ".join(
           f"CASE WHEN count({m}_ms) > 0 THEN true END AS {p}_{m}_right"
           for m in ("latency", "ttft") for p in ("p50", "p95", "p99")
       )}
FROM calls WHERE {RECENT} GROUP BY 1, 2, 3, 4"""

# reports answered from the rollup equal those from the calls
ORACLES["rollup_throughput"] = ORACLES["throughput"]
ORACLES["rollup_status_by_hour"] = ORACLES["status_by_hour"]
ORACLES["rollup_cost_by_day"] = ORACLES["cost_by_day"]

# --- pricing and admission ---------------------------------------------------------------

ORACLES["price_calls"] = f"""
WITH {CALLS}
SELECT id, total_cost, cost_missing, CASE WHEN cost_missing THEN 'true' END AS flag,
       json_extract_string(metadata, '$.k') AS k
FROM calls"""

ORACLES["unpriced_models"] = f"""
WITH {CALLS}
SELECT provider, model, count(*) AS n FROM calls WHERE cost_missing GROUP BY provider, model"""

TURN_REQUESTS = f"""
{PRICE_CTE},
turns AS (
  SELECT *, conv_id * 1000 + turn AS number,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER) AS started_at,
         '00000000-0000-4000-b000-' || lpad((conv_id * 1000 + turn)::VARCHAR, 12, '0') AS call_id
  FROM conversations WHERE role = 'assistant'
),
requests AS (
  SELECT t.*, coalesce(p.provider, 'openai') AS provider, coalesce(p.model, 'unlisted-model') AS model,
         p.p_in, p.p_out,
         CASE number % 10 WHEN 1 THEN 'CancelledError' WHEN 2 THEN 'RateLimitError'
              WHEN 3 THEN 'HTTPError' WHEN 4 THEN 'RuntimeError' WHEN 5 THEN 'AbortError'
              WHEN 6 THEN 'Error' END AS error_type
  FROM turns t LEFT JOIN prices p ON p.entry = t.number % {len(PRICES) + 1}
)"""

ORACLES["model_admission"] = f"""
WITH {TURN_REQUESTS}, registry(provider, model) AS (VALUES {REGISTRY_ROWS})
SELECT r.provider, r.model, count(*) AS n,
       (r.provider, r.model) IN (SELECT (provider, model) FROM registry) AS accepted
FROM requests r GROUP BY r.provider, r.model, accepted"""

ORACLES["call_lookup"] = f"""
WITH {CALLS}
SELECT id, provider, model, status, created_at FROM calls
WHERE id = '00000000-0000-4000-8000-000000000042'"""

ORACLES["adhoc_projection"] = f"""
WITH {CALLS} SELECT provider, model, latency_ms, total_cost FROM calls"""

# --- feed ------------------------------------------------------------------------------

# why each broken payload is refused, in the order in which the ways to break one come up
REASONS = """
payload:malformed latency_ms:missing provider:choice latency_ms:range record:unknown_key
log_id:uuid timestamp:instant log_id:missing session_id:missing provider:missing model:missing
request_status:missing input_tokens:missing output_tokens:missing total_cost:missing
timestamp:missing session_id:uuid message_id:uuid message_id:type model:length model:length
model:type request_status:choice latency_ms:type latency_ms:type ttft_ms:range ttft_ms:type
input_tokens:range input_tokens:range input_tokens:fraction output_tokens:range
output_tokens:fraction total_cost:range error_stack:type input_preview:length
output_preview:length output_preview:type metadata:type metadata:type
record:unknown_key,latency_ms:range model:missing,provider:choice
input_preview:type total_cost:type input_tokens:type output_tokens:type log_id:type
session_id:type provider:type request_status:type timestamp:type
""".split()

FEED = f"""
{CALLS},
feed AS (
  SELECT c.*, copy,
         lpad(event_id::VARCHAR, 12, '0') || '-' || copy AS origin_id,
         created_at + to_seconds(copy * 30) AS arrived_at,
         CASE WHEN event_id % 17 = 0 THEN (event_id // 17) % {len(REASONS)} END AS flaw,
         CASE event_id % 4 WHEN 0 THEN 'mail user' || event_id || '@example.test from 10.0.0.1'
              WHEN 1 THEN 'Ada Park paid with 4111 1111 1111 1111'
              WHEN 2 THEN 'key sk-' || md5(event_id::VARCHAR) || ' of 123-45-6789'
              ELSE 'Ada Park came from 2001:db8:0:0:0:0:2:1' END AS preview,
         CASE event_id % 4 WHEN 0 THEN 'mail [EMAIL] from [IP]'
              WHEN 1 THEN 'Ada Park paid with [CREDIT_CARD]'
              WHEN 2 THEN 'key [API_KEY] of [SSN]'
              ELSE 'Ada Park came from [IP]' END AS redacted,
         replace(metadata, ' ', '') AS tidy_metadata
  FROM calls c, (VALUES (0), (1)) AS copies(copy)
  WHERE copy = 0 OR event_id % 10 = 3
),
reasons(flaw, errors) AS (VALUES {", ".join(f"({i}, {_text(r)})" for i, r in enumerate(REASONS))}),
good AS (SELECT * FROM feed WHERE flaw IS NULL),
dead AS (SELECT origin_id, arrived_at, event_id, feed.flaw, errors
         FROM feed JOIN reasons ON feed.flaw = reasons.flaw)"""

ORACLES["validate_good"] = f"""
WITH {FEED}
SELECT origin_id, id AS log_id, session_id, NULL::VARCHAR AS message_id, provider, model,
       status AS request_status, latency_ms, ttft_ms, input_tokens, output_tokens, total_cost,
       NULL::VARCHAR AS error_stack,
       preview AS input_preview,
       NULL::VARCHAR AS output_preview, created_at AS "timestamp", tidy_metadata AS metadata
FROM good"""

ORACLES["validate_dead"] = f"WITH {FEED} SELECT origin_id, errors FROM dead"

ORACLES["feed_split_counts"] = f"""
WITH {FEED}
SELECT count(*) FILTER (flaw IS NULL) AS n_good, count(*) FILTER (flaw IS NOT NULL) AS n_dead
FROM feed"""

STORED_ROW = """id, NULL::VARCHAR AS message_id, session_id, provider, model, status, latency_ms,
       ttft_ms, input_tokens, output_tokens, total_cost, NULL::VARCHAR AS error_stack,
       redacted AS input_preview, NULL::VARCHAR AS output_preview, created_at,
       tidy_metadata AS metadata"""

ORACLES["dedupe_load"] = f"""
WITH {FEED}
SELECT origin_id, {STORED_ROW}
FROM good WHERE copy = 0 AND created_at >= TIMESTAMP '2024-01-08'"""

ORACLES["dedupe_dead"] = f"""
WITH {FEED}
SELECT origin_id, 'id:duplicate' AS errors
FROM good WHERE copy = 1 OR created_at < TIMESTAMP '2024-01-08'"""

ORACLES["stream_load"] = f"WITH {FEED} SELECT {STORED_ROW} FROM good WHERE copy = 0"

ORACLES["stream_load_two"] = ORACLES["stream_load"]

ORACLES["load_with_entities"] = f"""
WITH {FEED}
SELECT origin_id, id, replace(redacted, 'Ada Park', '[PERSON]') AS input_preview FROM good"""

PERSON = "replace(redacted, 'Ada Park', '[PERSON]')"

ORACLES["load_isolated"] = f"""
WITH {FEED}
SELECT id, status, {PERSON} AS input_preview, created_at
FROM good WHERE copy = 0 AND event_id % 101 <> 7"""

ORACLES["load_isolated_dead"] = f"""
WITH {FEED}
SELECT origin_id, errors, 1 AS attempts FROM dead
UNION ALL SELECT origin_id, 'input_preview:ValueError', 3 FROM good WHERE event_id % 101 = 7
UNION ALL SELECT origin_id, 'id:duplicate', 1 FROM good WHERE copy = 1 AND event_id % 101 <> 7"""

ORACLES["load_halved"] = f"""
WITH {FEED}
SELECT id AS place, {PERSON} AS input_preview, 0 AS attempts
FROM good WHERE copy = 0 AND event_id NOT IN (107, 208)
UNION ALL SELECT origin_id, 'row:failed', 3 FROM good WHERE event_id IN (107, 208)
UNION ALL SELECT origin_id, errors, 1 FROM dead
UNION ALL SELECT origin_id, 'id:duplicate', 1
FROM good WHERE copy = 1 AND event_id NOT IN (107, 208)"""

ORACLES["replay_attempts"] = f"""
WITH {FEED}
SELECT origin_id, errors, 3 AS attempts FROM dead
UNION ALL SELECT origin_id, 'id:duplicate', 3 FROM good WHERE copy = 1"""

ORACLES["load_visible"] = f"""
WITH {FEED}
SELECT id AS place, 'call' AS kind FROM good WHERE copy = 0 AND event_id % 3 <> 1
UNION ALL SELECT origin_id, errors FROM dead WHERE event_id % 3 <> 1
UNION ALL SELECT origin_id, 'id:duplicate' FROM good WHERE copy = 1 AND event_id % 3 <> 1"""

ORACLES["compacted_reload"] = f"""
WITH {FEED}
SELECT {STORED_ROW}, CASE WHEN event_id % 3 = 2 THEN 's' ELSE 'compacted' END AS load_stream,
       CASE WHEN event_id % 3 = 2 THEN 2 ELSE 0 END AS load_batch
FROM good WHERE copy = 0"""

ORACLES["compacted_clustered"] = f"""
WITH {CALLS}
SELECT id, session_id, model, created_at, status, latency_ms,
       CASE WHEN event_id % 3 = 2 THEN 's' ELSE 'compacted' END AS load_stream,
       CASE WHEN event_id % 3 = 2 THEN 2 ELSE 0 END AS load_batch
FROM calls"""

ORACLES["load_indexed"] = f"""
WITH {FEED}
SELECT id AS place, 'call' AS kind, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS batch
FROM good WHERE copy = 0
UNION ALL SELECT origin_id, errors, b FROM dead, range(2) r(b) WHERE b = 1 OR event_id % 3 = 0
UNION ALL SELECT origin_id, 'id:duplicate', b FROM good, range(2) r(b)
WHERE CASE WHEN b = 1 THEN copy = 1 OR event_id % 3 = 0 ELSE copy = 1 AND event_id % 3 = 0 END"""

ORACLES["call_lookup_indexed"] = ORACLES["call_lookup"]

ORACLES["stream_dead"] = f"""
WITH {FEED}
SELECT origin_id, errors, 1 AS attempts FROM dead
UNION ALL SELECT origin_id, 'id:duplicate', 1 FROM good WHERE copy = 1"""

ORACLES["stream_dedupe"] = f"""
WITH {FEED} SELECT id, created_at, status FROM good WHERE copy = 0"""

SPREAD = f"""
{CALLS},
spread AS (SELECT id, created_at + to_days((event_id % 3 * 31)::INTEGER) AS created_at FROM calls)"""

ORACLES["month_partitions"] = f"""
WITH {SPREAD},
months AS (SELECT DISTINCT date_trunc('month', created_at)::DATE AS m FROM spread),
every AS (
  SELECT m FROM months
  UNION
  SELECT ((SELECT min(m) FROM months) + to_months(i::INTEGER))::DATE FROM range(14) r(i)
)
SELECT strftime(m, 'calls_%Y_%m') AS name, m AS lower, (m + INTERVAL 1 MONTH)::DATE AS upper
FROM every"""

ORACLES["route_out_of_range"] = f"""
WITH {SPREAD}
SELECT id AS origin_id, 'created_at:no_partition' AS errors FROM spread
WHERE NOT (created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-03-01')"""

ORACLES["pipeline_counters"] = f"""
WITH {FEED}
SELECT (SELECT count(*) FROM feed WHERE event_id % 5 = 0) AS feed_len,
       (SELECT count(*) FROM dead) AS dead_len,
       (SELECT count(*) FROM feed WHERE event_id % 5 = 0) >= 1000 AS saturated"""

ORACLES["unprocessed_feed"] = f"""
WITH {FEED}
SELECT origin_id, arrived_at FROM feed
WHERE event_id % 5 = 0 AND arrived_at <= TIMESTAMP '2024-01-20' - INTERVAL 60 SECOND"""

ORACLES["replay_dead"] = f"""
WITH {FEED}
SELECT origin_id, CASE WHEN flaw = 2 THEN '' ELSE errors END AS errors FROM dead"""

# --- responses and chunks ----------------------------------------------------------------

ORACLES["extract_completion"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id,
       CASE WHEN number % 4 <> 3 THEN number % 100 ELSE 0 END::INTEGER AS input_tokens,
       CASE WHEN number % 4 <> 3 THEN length(text) ELSE 0 END::INTEGER AS output_tokens,
       CASE WHEN number % 13 <> 0 THEN text ELSE '' END AS output_text,
       CASE WHEN number % 5 = 0 THEN 'fp-' || (number % 11) END AS system_fingerprint,
       CASE WHEN number % 13 <> 0 THEN 'stop' END AS finish_reason,
       'finish_reason,system_fingerprint' AS members
FROM turns"""

ORACLES["extract_router"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id,
       CASE WHEN number % 4 <> 3 THEN number % 100 ELSE 0 END::INTEGER AS input_tokens,
       CASE WHEN number % 4 <> 3 THEN length(text) ELSE 0 END::INTEGER AS output_tokens,
       CASE WHEN number % 13 <> 0 THEN text ELSE '' END AS output_text,
       CASE WHEN number % 2 = 0 THEN 'Anthropic' END AS openrouter_upstream,
       CASE WHEN number % 3 <> 0 THEN 'gen-' || number END AS openrouter_generation_id,
       'finish_reason' || CASE WHEN number % 3 <> 0 THEN ',openrouter_generation_id' ELSE '' END
         || CASE WHEN number % 2 = 0 THEN ',openrouter_upstream' ELSE '' END
         || ',system_fingerprint' AS members
FROM turns"""

ORACLES["extract_messages"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id,
       CASE WHEN number % 4 <> 3 THEN number % 100 ELSE 0 END::INTEGER AS input_tokens,
       CASE WHEN number % 4 <> 3 THEN length(text) ELSE 0 END::INTEGER AS output_tokens,
       text AS output_text, 'end_turn' AS stop_reason,
       CASE WHEN number % 4 <> 3 AND number % 2 = 0 THEN (number % 7)::VARCHAR END
         AS cache_read_input_tokens,
       'cache_creation_input_tokens,cache_read_input_tokens,stop_reason' AS members
FROM turns"""

WORDS = "len(string_split(text, ' '))"
COMPLETION_CHUNKS = f"(1 + {WORDS} + CASE WHEN number % 2 = 0 THEN 2 ELSE 0 END)"
# position of the first word that is not empty, counted from 0 (an empty first word
# has no text, every later piece has at least its space)
FIRST_WORD = "CASE WHEN starts_with(text, ' ') THEN 1 ELSE 0 END"


def _stamp(position: str) -> str:
    return f"started_at + to_milliseconds(20 * (({position}) + 1))"


ASSEMBLED = f"""
call_id, text, length(text)::BIGINT AS n_chars,
CASE WHEN number % 2 = 0 THEN number % 100 END::INTEGER AS input_tokens,
CASE WHEN number % 2 = 0 THEN length(text) END::INTEGER AS output_tokens,
{_stamp(f"CASE WHEN number % 2 = 0 THEN 2 ELSE 1 END + {FIRST_WORD}")} AS first_text_at,
{_stamp(f"{COMPLETION_CHUNKS} - 1")} AS last_at,
{COMPLETION_CHUNKS}::BIGINT AS n_chunks"""

ORACLES["assemble_completion"] = f"WITH {TURN_REQUESTS} SELECT {ASSEMBLED} FROM turns"

ORACLES["stream_assemble"] = ORACLES["assemble_completion"]

ORACLES["assemble_messages"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id, text, length(text)::BIGINT AS n_chars,
       (number % 100)::INTEGER AS input_tokens,
       CASE WHEN number % 2 = 0 THEN length(text) END::INTEGER AS output_tokens,
       CASE WHEN number % 2 = 0 THEN 'end_turn' END AS stop_reason,
       {_stamp(f"1 + {FIRST_WORD}")} AS first_text_at,
       {_stamp(f"{WORDS} + 2")} AS last_at,
       ({WORDS} + 3)::BIGINT AS n_chunks
FROM turns"""

ORACLES["assemble_cut"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id,
       CASE WHEN number % 10 <> 1 THEN text
            ELSE array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') END AS text,
       CASE WHEN number % 10 <> 1 THEN {COMPLETION_CHUNKS} ELSE least(5, {COMPLETION_CHUNKS}) END
         ::BIGINT AS n_chunks
FROM turns"""

ORACLES["outcome_python"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id, CASE number % 10 WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'RATE_LIMITED'
       WHEN 3 THEN 'RATE_LIMITED' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'ERROR'
       ELSE 'SUCCESS' END AS status
FROM turns"""

ORACLES["outcome_web"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id, CASE number % 10 WHEN 1 THEN 'ERROR' WHEN 2 THEN 'ERROR'
       WHEN 3 THEN 'RATE_LIMITED' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'CANCELLED'
       WHEN 6 THEN 'CANCELLED' ELSE 'SUCCESS' END AS status
FROM turns"""

PROMPT = "'turn ' || turn || ' please'"

ORACLES["backfill_tokens"] = f"""
WITH {TURN_REQUESTS}
SELECT call_id,
       CASE WHEN number % 2 = 0 THEN number % 100 ELSE ceil(length({PROMPT}) / 4.0) END::INTEGER
         AS input_tokens,
       CASE WHEN number % 2 = 0 THEN length(text) ELSE ceil(length(text) / 4.0) END::INTEGER
         AS output_tokens,
       number % 2 <> 0 AS cost_estimated
FROM turns"""

ORACLES["build_records"] = f"""
WITH {TURN_REQUESTS},
counted AS (
  SELECT *,
         CASE WHEN number % 2 = 0 THEN number % 100 ELSE ceil(length({PROMPT}) / 4.0) END::INTEGER
           AS input_tokens,
         CASE WHEN number % 2 = 0 THEN length(text) ELSE ceil(length(text) / 4.0) END::INTEGER
           AS output_tokens
  FROM requests
)
SELECT call_id AS log_id,
       '00000000-0000-4000-a000-' || lpad(conv_id::VARCHAR, 12, '0') AS session_id,
       call_id AS message_id, provider, model,
       CASE number % 10 WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'RATE_LIMITED'
            WHEN 3 THEN 'RATE_LIMITED' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'ERROR'
            ELSE 'SUCCESS' END AS request_status,
       (length(text) * 1500 + 500) / 1000.0::DOUBLE AS latency_ms,
       (20 * (CASE WHEN number % 2 = 0 THEN 3 ELSE 2 END + {FIRST_WORD}))::DOUBLE AS ttft_ms,
       input_tokens, output_tokens,
       coalesce(round(input_tokens / 1000.0::DOUBLE * p_in + output_tokens / 1000.0::DOUBLE * p_out,
                      8), 0.0) AS total_cost,
       error_type AS error_stack, {PROMPT} AS input_preview,
       CASE WHEN text <> '' THEN left(text, 500) END AS output_preview,
       started_at AS "timestamp", turn::VARCHAR AS turns,
       CASE WHEN number % 2 <> 0 THEN 'true' END AS cost_estimated,
       CASE WHEN p_in IS NULL THEN 'true' END AS cost_missing
FROM counted"""

ORACLES["merge_metadata"] = """
SELECT event_id,
       CASE WHEN event_id % 2 = 0 THEN 'patched' ELSE json_extract_string(props, '$.k') END AS k,
       event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'true' END AS cost_missing
FROM events"""

# --- redaction -----------------------------------------------------------------------------

PATTERNS = {name: _text(pattern) for name, pattern, _ in RULES}


def _valid_card(match: str) -> str:
    digits = f"regexp_replace({match}, '[^0-9]', '', 'g')"
    weighted = (
        f"list_transform(list_reverse(string_split({digits}, '')), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN c::INTEGER * 2 - 9 "
        "ELSE c::INTEGER * 2 END)"
    )
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum({weighted}) % 10 = 0)"


def _mask_cards(text: str) -> str:
    pattern = PATTERNS["CREDIT_CARD"]
    masked = (
        f"list_transform(regexp_extract_all({text}, {pattern}), lambda m: "
        f"CASE WHEN {_valid_card('m')} THEN '[CREDIT_CARD]' ELSE m END)"
    )
    return (
        f"array_to_string(list_transform(string_split_regex({text}, {pattern}), "
        f"lambda piece, pos: piece || coalesce(({masked})[pos], '')), '')"
    )


def _redaction_steps(source: str) -> str:
    """CTEs t0 .. t7: the text before the first and after every rule."""
    steps = [f"t0 AS ({source})"]
    for i, (name, _, placeholder) in enumerate(RULES):
        if name == "CREDIT_CARD":
            replaced = f"CASE WHEN regexp_matches(text, {PATTERNS[name]}) THEN {_mask_cards('text')} ELSE text END"
        else:
            replaced = f"regexp_replace(text, {PATTERNS[name]}, {_text(placeholder)}, 'g')"
        steps.append(f"t{i + 1} AS (SELECT doc_id, {replaced} AS text FROM t{i})")
    return ", ".join(steps)


SENSITIVE = """
SELECT doc_id,
       CASE doc_id % 5 WHEN 1 THEN 'key sk-' || md5(doc_id::VARCHAR) || ' '
            WHEN 2 THEN 'ssn 1' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-45-6789 '
            WHEN 3 THEN 'from 2001:db8:0:0:0:0:2:' || (doc_id % 100) || ' '
            WHEN 4 THEN 'id AKIA' || upper(left(md5(doc_id::VARCHAR), 16)) || ' '
            ELSE '' END || text AS text
FROM documents"""

ORACLES["redact_text"] = f"""
WITH {_redaction_steps(SENSITIVE)}
SELECT doc_id, text AS redacted FROM t{len(RULES)}"""

ORACLES["redact_previews"] = f"""
WITH {_redaction_steps(f"SELECT doc_id, left(text, 500) AS text FROM ({SENSITIVE})")}
SELECT doc_id, text AS redacted FROM t{len(RULES)}"""

ORACLES["redact_card_only"] = f"""
SELECT doc_id, {_mask_cards("text")} AS redacted FROM documents"""


def _hits(name: str) -> str:
    found = f"regexp_extract_all(text, {PATTERNS[name]})"
    if name == "CREDIT_CARD":
        found = f"list_filter({found}, lambda m: {_valid_card('m')})"
    return f"len({found})"


ORACLES["redaction_report"] = (
    f"WITH {_redaction_steps(SENSITIVE)} "
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS step, {_text(name)} AS rule, "
        f"count(*) FILTER ({_hits(name)} > 0) AS rows_hit, "
        f"coalesce(sum({_hits(name)}), 0)::BIGINT AS replacements FROM t{i}"
        for i, (name, _, _) in enumerate(RULES)
    )
)

ORACLES["replace_spans"] = """
WITH d AS (SELECT doc_id, text, position(' ' IN text) AS gap FROM documents)
SELECT doc_id,
       CASE doc_id % 3
         WHEN 0 THEN '[PERSON]' || substring(text, gap + 1, 3) || '[LOCATION]' || substring(text, gap + 10)
         WHEN 1 THEN '[PERSON]' || substring(text, gap + 1)
         ELSE text END AS redacted
FROM d"""

ORACLES["mask_secrets"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ''
                    ELSE left(md5(text), 4) || '…' || right(md5(text), 4) END AS masked
FROM documents"""

ORACLES["allowlist_tokens"] = f"""
WITH {CALLS},
tokens AS (
  SELECT unnest(string_split_regex(provider || '/' || model, '[/.-]')) AS token FROM calls
)
SELECT token, count(*) AS n,
       lower(token) IN ({", ".join(_text(t) for t in ALLOWED_TOKENS)}) AS allowed
FROM tokens GROUP BY token"""

# --- conversation store ------------------------------------------------------------------

CHAT = """
messages AS (
  SELECT '00000000-0000-4000-b000-' || lpad((conv_id * 1000 + turn)::VARCHAR, 12, '0') AS id,
         '00000000-0000-4000-a000-' || lpad(conv_id::VARCHAR, 12, '0') AS session_id,
         role, text AS content,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER) AS created_at
  FROM conversations
),
used AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
sessions AS (
  SELECT '00000000-0000-4000-a000-'
           || lpad((conv_id + CASE WHEN silent THEN 500000000 ELSE 0 END)::VARCHAR, 12, '0') AS id,
         '00000000-0000-4000-c000-' || lpad((conv_id % 10)::VARCHAR, 12, '0') AS user_id,
         CASE WHEN conv_id % 3 = 0 THEN 'Session ' || conv_id END AS title,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) AS created_at,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER)
           + to_minutes(CASE WHEN silent THEN 0 ELSE last_turn END::INTEGER) AS updated_at
  FROM used, (VALUES (false), (true)) AS s(silent)
  WHERE NOT silent OR conv_id % 25 = 0
),
users AS (
  SELECT '00000000-0000-4000-c000-' || lpad((conv_id % 10)::VARCHAR, 12, '0') AS id,
         'user' || (conv_id % 10) AS username,
         TIMESTAMP '2024-01-01' + to_hours(min(conv_id)::INTEGER) AS created_at,
         TIMESTAMP '2024-01-01' + to_hours(max(conv_id)::INTEGER) AS last_seen_at
  FROM conversations GROUP BY conv_id % 10
)"""

MERGED_USERS = f"""
{CHAT},
seen AS (
  SELECT CASE WHEN conv_id % 7 = 0 THEN 'User' ELSE 'user' END || (conv_id % 12) AS username,
         TIMESTAMP '2024-01-01' + to_days((300 + turn)::INTEGER) AS seen_at
  FROM conversations
),
arrivals AS (
  SELECT username, min(seen_at) AS first_at, max(seen_at) AS last_at FROM seen GROUP BY username
),
merged AS (
  SELECT coalesce(u.id, substr(md5(username), 1, 8) || '-' || substr(md5(username), 9, 4) || '-'
                        || substr(md5(username), 13, 4) || '-' || substr(md5(username), 17, 4)
                        || '-' || substr(md5(username), 21, 12)) AS id,
         username, coalesce(u.created_at, a.first_at) AS created_at,
         greatest(u.last_seen_at, a.last_at) AS last_seen_at
  FROM users u FULL JOIN arrivals a USING (username)
)"""

ORACLES["upsert_users"] = f"WITH {MERGED_USERS} SELECT * FROM merged"

ORACLES["users_by_name"] = f"""
WITH {MERGED_USERS},
ranked AS (
  SELECT lower(username) AS name, *,
         row_number() OVER (PARTITION BY lower(username) ORDER BY created_at, id) AS rn
  FROM merged
)
SELECT name, id, username, created_at, last_seen_at FROM ranked WHERE rn = 1"""

ORACLES["find_user"] = f"""
WITH {MERGED_USERS}
SELECT * FROM merged WHERE lower(username) = lower('USER7') ORDER BY created_at, id LIMIT 1"""

ORACLES["create_sessions"] = f"""
WITH {CHAT} SELECT id, user_id, title, created_at, created_at AS updated_at FROM sessions"""

ORACLES["append_messages"] = f"""
WITH {CHAT},
opening AS (
  SELECT session_id, left(content, 60) AS title,
         row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS rn
  FROM messages WHERE role = 'user'
)
SELECT s.id, s.user_id, coalesce(s.title, o.title) AS title, s.created_at,
       greatest(s.created_at, (SELECT max(m.created_at) FROM messages m WHERE m.session_id = s.id))
         AS updated_at
FROM sessions s LEFT JOIN opening o ON o.session_id = s.id AND o.rn = 1"""

ORACLES["append_messages_rows"] = f"""
WITH {CHAT},
marked AS (
  SELECT *, right(id, 12)::BIGINT % 7 = 3 AS robot, right(id, 12)::BIGINT % 5 = 2 AS stray
  FROM messages
)
SELECT id, CASE WHEN stray THEN 'nowhere' ELSE session_id END AS session_id,
       CASE WHEN robot THEN 'robot' ELSE role END AS role, content, created_at,
       concat_ws(',', CASE WHEN robot THEN 'role:choice' END,
                 CASE WHEN stray THEN 'session_id:unknown' END) AS errors
FROM marked"""

ORACLES["chat_rules"] = f"""
WITH {CHAT}
SELECT 'message' AS kind, 'role:choice' AS rule, count(*) AS n
FROM messages WHERE right(id, 1) = '3' HAVING count(*) > 0
UNION ALL
SELECT 'message', 'content:length', count(*) FROM messages WHERE right(id, 1) = '2' HAVING count(*) > 0
UNION ALL
SELECT 'user', 'username:blank', count(*) FROM conversations WHERE conv_id % 7 = 0 HAVING count(*) > 0
UNION ALL
SELECT 'user', 'username:length', count(*) FROM conversations
WHERE conv_id % 7 <> 0 AND conv_id % 12 = 1 HAVING count(*) > 0
UNION ALL
SELECT 'session', 'title:length', count(*) FROM sessions WHERE right(id, 1) = '3' HAVING count(*) > 0"""

LISTED = f"""
{CHAT},
listed AS (
  SELECT s.*,
         (SELECT count(*) FROM messages m WHERE m.session_id = s.id) AS message_count,
         (SELECT left(m.content, 160) FROM messages m WHERE m.session_id = s.id
          ORDER BY m.created_at DESC, m.id DESC LIMIT 1) AS preview
  FROM sessions s
)"""

ORACLES["session_list"] = f"""
WITH {LISTED}
SELECT * REPLACE (nullif(preview, '') AS preview) FROM listed
WHERE user_id = '00000000-0000-4000-c000-000000000003' ORDER BY updated_at DESC, id LIMIT 50"""

ORACLES["session_lists"] = f"""
WITH {LISTED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id)::INTEGER AS position
  FROM listed
)
SELECT * REPLACE (nullif(preview, '') AS preview) FROM ranked WHERE position <= 50"""

ORACLES["session_detail"] = f"""
WITH {LISTED}
SELECT s.*, m.id AS message_id, m.role, m.content, m.created_at AS sent_at,
       CASE WHEN m.id IS NOT NULL
            THEN row_number() OVER (PARTITION BY s.id ORDER BY m.created_at, m.id) END AS position
FROM listed s LEFT JOIN messages m ON m.session_id = s.id"""

ORACLES["transcript"] = f"""
WITH {CHAT}
SELECT id, session_id, role, content, created_at FROM messages
WHERE session_id = '00000000-0000-4000-a000-000000000005'"""

TURNS = f"""
{PRICE_CTE}, caps(model, cap) AS (VALUES {CAP_ROWS}),
turns AS (
  SELECT c.conv_id, c.turn, c.role, c.text, p.model
  FROM conversations c JOIN prices p ON p.entry = c.conv_id % 24
)"""


def _window(cap: str) -> str:
    return f"""
{TURNS},
numbered AS (
  SELECT t.*, {cap} AS cap,
         row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) AS from_start,
         row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS from_end
  FROM turns t LEFT JOIN caps USING (model)
),
shown AS (
  SELECT conv_id, turn, role, text, model,
         row_number() OVER (PARTITION BY conv_id ORDER BY role = 'system' DESC, turn)::INTEGER
           AS position
  FROM numbered
  WHERE (role = 'system' AND from_start = 1) OR (role <> 'system' AND from_end <= cap)
)"""


ORACLES["context_window"] = f"WITH {_window('coalesce(caps.cap, 20)')} SELECT * FROM shown"

ORACLES["context_window_small"] = f"WITH {_window('2')} SELECT * FROM shown"

ORACLES["context_window_caps"] = f"""
WITH {_window("CASE t.model WHEN 'gpt-4o-mini' THEN 1 WHEN 'gpt-4o' THEN 2 ELSE 20 END")}
SELECT * FROM shown"""

ORACLES["last_user_message"] = f"""
WITH {_window('2')}
SELECT conv_id, count(*) AS turns, arg_max(text, turn) FILTER (role = 'user') AS last_user_text
FROM shown GROUP BY conv_id"""

ORACLES["calls_with_session"] = f"""
WITH {CHAT},
asked AS (
  SELECT '00000000-0000-4000-b000-' || lpad((conv_id * 1000 + turn)::VARCHAR, 12, '0') AS call_id,
         '00000000-0000-4000-a000-' || lpad(conv_id::VARCHAR, 12, '0') AS session_id
  FROM conversations WHERE role = 'assistant'
)
SELECT call_id, asked.session_id, s.user_id, s.title, m.role AS message_role
FROM asked LEFT JOIN sessions s ON s.id = asked.session_id LEFT JOIN messages m ON m.id = call_id"""

ORACLES["purge_users"] = f"""
WITH {CHAT},
doomed AS (SELECT id FROM users WHERE username IN ('user2', 'user5')),
kept AS (SELECT * FROM sessions WHERE user_id NOT IN (SELECT id FROM doomed))
SELECT 'user' AS kind, id FROM users WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'session', id FROM kept
UNION ALL SELECT 'message', id FROM messages WHERE session_id IN (SELECT id FROM kept)"""

# the stored forms of these operators give the same rows
ORACLES["stored_upsert_users"] = ORACLES["upsert_users"]
ORACLES["stored_append"] = ORACLES["append_messages"]
ORACLES["stored_purge"] = ORACLES["purge_users"]
ORACLES["session_activity_kept"] = ORACLES["session_activity"]

# --- streams -----------------------------------------------------------------------------

ORACLES["stream_rollup"] = f"""
WITH {CALLS}
SELECT date_trunc('hour', created_at) AS hour, provider, model, status, count(*) AS n,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       round(sum(latency_ms), 6) AS total_latency_ms, round(sum(total_cost), 9) AS total_cost
FROM calls GROUP BY 1, 2, 3, 4"""

ORACLES["stream_preview"] = f"""
WITH {TURN_REQUESTS}, whole AS ({ORACLES["assemble_messages"]})
SELECT * REPLACE (left(text, 500) AS text), true AS complete FROM whole"""
