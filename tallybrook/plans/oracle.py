"""The SQL each registered query is checked against (DuckDB dialect)."""

from __future__ import annotations

from ..sources.synthetic import EVENT_TYPES, PAGES

_DAY = "strftime(ts, '%Y-%m-%d')"
_HOUR = "strftime(ts, '%Y-%m-%d-%H')"

_CATEGORY = """CASE
    WHEN lower(event_type) IN ('page_view', 'click', 'scroll', 'hover') THEN 'engagement'
    WHEN lower(event_type) IN ('purchase', 'add_to_cart', 'remove_from_cart', 'checkout')
      THEN 'commerce'
    WHEN lower(event_type) IN ('login', 'logout', 'signup', 'password_reset') THEN 'auth'
    WHEN lower(event_type) IN ('search', 'filter', 'sort') THEN 'discovery'
    WHEN lower(event_type) IN ('error', 'crash', 'timeout') THEN 'error'
    ELSE 'other' END"""

# Requests derived from the events; the faults are those of sources.adapter.
_REQ = """req AS (
  SELECT event_id AS id, ts,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN repeat('x', 51)
         WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 43 = 0 THEN repeat(' ', 60)
         ELSE event_type END AS event_type,
    CASE WHEN event_id % 29 = 0 THEN '  ' || chr(9) WHEN event_id % 31 = 0 THEN repeat('u', 101)
         ELSE user_id::VARCHAR END AS user_id,
    CASE WHEN event_id % 37 <> 0 THEN props END AS payload,
    user_id::VARCHAR AS api_key,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN ',10.9.9.9'
         WHEN event_id % 3 <> 0 THEN ' 203.0.113.' || (event_id % 250) || ' , 10.0.0.1'
         END AS xff,
    '192.0.2.' || (user_id % 250) AS remote_addr,
    (event_id // 1000) * 1000 + CASE WHEN event_id % 1000 < 150 THEN 0
      ELSE (event_id % 1000 - 150) // 3 + 1 END AS batch_id
  FROM events),
chk AS (
  SELECT *, coalesce(event_type IS NULL OR NOT regexp_matches(event_type, '[^\\x01-\\x20]'), true)
             AS no_type,
    coalesce(length(event_type) > 50, false) AS long_type,
    coalesce(user_id IS NULL OR NOT regexp_matches(user_id, '[^\\x01-\\x20]'), true) AS no_user,
    coalesce(length(user_id) > 100, false) AS long_user,
    payload IS NULL AS no_payload,
    coalesce(nullif(trim(split_part(xff, ',', 1)), ''), remote_addr) AS ip
  FROM req),
val AS (
  SELECT *, NOT (no_type OR long_type OR no_user OR long_user OR no_payload) AS ok,
    no_type::INT + long_type::INT + no_user::INT + long_user::INT + no_payload::INT AS bad
  FROM chk)"""

_PROFILES = """(
  SELECT c_custkey AS user_id, c_mktsegment AS segment, n_name AS nation
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) p"""

# Batches as arrays; those of every 7th and 11th number are empty or null.
_ARRAYS = _REQ + """,
arr AS (
  SELECT *, CASE WHEN batch_id % 7 <> 0 AND batch_id % 11 <> 0
    THEN row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1 END AS pos,
    'events[' || pos || '].' AS field,
    concat_ws('; ',
      field || CASE WHEN no_type THEN 'eventType: eventType is required' END,
      field || CASE WHEN long_type THEN 'eventType: eventType must be under 50 characters' END,
      field || CASE WHEN no_user THEN 'userId: userId is required' END,
      field || CASE WHEN long_user THEN 'userId: userId must be under 100 characters' END,
      field || CASE WHEN no_payload THEN 'payload: payload is required' END) AS told
  FROM val)"""

_LETTERS = """msg AS (
  SELECT CASE WHEN event_id % 71 <> 0 OR event_id % 41 = 0 OR event_id % 67 = 0
      THEN event_id END AS id, user_id::VARCHAR AS user_id, event_id % 53 = 0 AS no_user,
    CASE WHEN event_id % 41 = 0 THEN 'malformed_json'
         WHEN event_id % 67 = 0 THEN 'payload_not_object'
         WHEN event_id % 61 = 0 THEN 'null_payload'
         WHEN event_id % 47 = 0 THEN 'null_event_type'
         WHEN event_id % 59 = 0 THEN 'null_timestamp'
         WHEN event_id % 53 = 0 THEN 'null_user_id'
         WHEN event_id % 71 = 0 THEN 'null_id' END AS reason
  FROM events)"""

# Moving baseline over daily counts, in plain floating point, one day after another.
_EMA = """cnt AS (
  SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n
  FROM events GROUP BY 1, 2),
num AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY window_start) AS rn FROM cnt),
ema AS (
  SELECT user_id, window_start, n, rn, 0::DOUBLE AS mean, 0::DOUBLE AS variance,
    n::DOUBLE AS mean2, 0::DOUBLE AS variance2
  FROM num WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.window_start, x.n, x.rn, e.mean2, e.variance2,
    (1 - 0.1::DOUBLE) * e.mean2 + 0.1::DOUBLE * x.n,
    (1 - 0.1::DOUBLE) * e.variance2 + 0.1::DOUBLE * (x.n - e.mean2) * (x.n - e.mean2)
  FROM ema e JOIN num x ON x.user_id = e.user_id AND x.rn = e.rn + 1),
zed AS (
  SELECT *, rn - 1 AS observations, (n - mean) / greatest(sqrt(variance), 1) AS z,
    window_start + INTERVAL 1 DAY AS detected_at
  FROM ema)"""


def _anomalies(threshold: float) -> str:
    return _EMA + f""",
ano AS (
  SELECT strftime(detected_at, '%Y-%m-%d-%H') AS time_bucket, detected_at,
    'event_rate:' || user_id || ':' || strftime(detected_at, '%Y%m%d%H%M%S') AS anomaly_id,
    user_id, 'event_rate' AS metric, n::DOUBLE AS observed_value,
    mean AS expected_value, z AS z_score,
    CASE WHEN abs(z) > 5 THEN 'HIGH' WHEN abs(z) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM zed WHERE observations >= 10 AND abs(z) > {threshold})"""


def _bucket(source: str) -> str:
    """Token bucket of 5, refilled at 2 a day, in plain floating point."""
    refilled = ("least(5::DOUBLE, b.tokens + (epoch_us(x.ts) - epoch_us(b.ts)) / 1e6::DOUBLE"
                " * (2::DOUBLE / 86400))")
    return f"""seq AS (
  SELECT id, api_key, ts, row_number() OVER (PARTITION BY api_key ORDER BY ts, id) AS rn
  FROM {source}),
bkt AS (
  SELECT id, api_key, ts, rn, true AS allowed, 4::DOUBLE AS tokens FROM seq WHERE rn = 1
  UNION ALL
  SELECT x.id, x.api_key, x.ts, x.rn, {refilled} >= 1,
    CASE WHEN {refilled} >= 1 THEN {refilled} - 1 ELSE {refilled} END
  FROM bkt b JOIN seq x ON x.api_key = b.api_key AND x.rn = b.rn + 1)"""


# Calls: a request without a batch, or a batch with the key of its first request.
_CALLS = _REQ + """,
sent AS (SELECT *, CASE WHEN id % 1000 < 700 THEN batch_id END AS batch FROM val),
calls AS (
  SELECT batch AS batch_id, first(id ORDER BY ts, id) AS id,
    first(api_key ORDER BY ts, id) AS api_key, min(ts) AS ts, count(*) AS n_events,
    bool_and(ok) AND count(*) <= 100 AS good
  FROM sent WHERE batch IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, id, api_key, ts, 1, ok FROM sent WHERE batch IS NULL),
tried AS (SELECT id, api_key, ts FROM calls WHERE good),
""" + _bucket("tried") + """,
judged AS (
  SELECT c.*, CASE WHEN NOT good THEN 'invalid' WHEN allowed THEN 'accepted'
    ELSE 'rate_limited' END AS outcome
  FROM calls c LEFT JOIN bkt USING (id)),
taken AS (
  SELECT * FROM sent WHERE batch IN (SELECT batch_id FROM judged WHERE outcome = 'accepted')
  UNION ALL SELECT * FROM sent WHERE batch IS NULL
    AND id IN (SELECT id FROM judged WHERE batch_id IS NULL AND outcome = 'accepted'))"""

_OUTCOMES = _REQ + ",\nvalid AS (SELECT id, api_key, ts FROM val WHERE ok),\n" + \
    _bucket("valid") + """,
outc AS (
  SELECT id, ts, CASE WHEN NOT allowed THEN 'rate_limited' WHEN id % 101 = 0 THEN 'failed'
    ELSE 'processed' END AS outcome FROM bkt
  UNION ALL SELECT id, ts, 'invalid' FROM val WHERE NOT ok)"""

_NOW = "(SELECT max(ts) FROM events)"


_TOKENS_LEFT = f"""WITH RECURSIVE {_REQ},
{_bucket("req")},
tail AS (SELECT api_key, max(rn) AS rn FROM bkt GROUP BY 1)
SELECT api_key, floor(least(5::DOUBLE, tokens
  + (epoch_us({_NOW}) + 7200000000 - epoch_us(ts)) / 1e6::DOUBLE
  * (2::DOUBLE / 86400)))::INT AS tokens_left
FROM bkt JOIN tail USING (api_key, rn)
UNION ALL SELECT 'never-seen', 5::INT"""


def _draw(stream: int, sides: int) -> str:
    x = f"((event_id + {1 + 7919 * stream}) % 2147483647)"
    for factor in (48271, 69621, 16807):
        x = f"(({x} * {factor} + {12345 + stream}) % 2147483647)"
    return f"({x} % {sides})"


def _pick(choices: list[str], stream: int) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"([{listed}])[{_draw(stream, len(choices))} + 1]"


def _window_counts(minutes: int) -> str:
    start = f"time_bucket(INTERVAL '{minutes} minutes', ts)"
    return f"""SELECT user_id, event_type, {start} AS window_start,
  {start} + INTERVAL '{minutes} minutes' AS window_end, {minutes}::INT AS window_minutes,
  count(*) AS count FROM events GROUP BY ALL"""


_DAILY = f"""SELECT user_id, event_type, {_DAY} AS time_bucket, count(*) AS event_count
FROM events GROUP BY ALL"""

_THROTTLE = "WITH RECURSIVE " + _REQ + ",\n" + _bucket("req") + """
SELECT id, api_key, allowed, floor(tokens)::INT AS tokens_left FROM bkt"""

def _quantiles(value: str, name: str, source: str = "events") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT event_type, {p}::DOUBLE AS quantile, "
        f"round(quantile_cont({value}, {p}), 6) AS {name} FROM {source} GROUP BY 1"
        for p in (0.5, 0.95, 0.99))


def _sliding(every: int, span: int, by: str = "") -> str:
    """A frame over the times at which something is in sight, in plain seconds."""
    by, part = (f", {by}", f"PARTITION BY {by} ") if by else ("", "")
    return f"""WITH slot AS (
  SELECT floor(epoch_us(ts) / {every}000000)::BIGINT + 1 AS s{by}, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT DISTINCT unnest(range(s, s + {span // every})) AS s{by} FROM slot),
framed AS (
  SELECT s{by}, sum(coalesce(n, 0)) OVER ({part}ORDER BY s
    RANGE BETWEEN {span // every - 1} PRECEDING AND CURRENT ROW)::BIGINT AS n
  FROM grid LEFT JOIN slot USING (s{by}))
SELECT make_timestamp(s * {every}000000) AS "at"{by}, n, n / {span}::DOUBLE AS per_second FROM framed"""


# Lookups on stored tables give what the lookups on all events give, folded counters what
# the increments give.
_SAME = {"stream_folded_counters": "stream_daily_counters",
         "stored_user_events": "user_recent_events", "stored_user_events_of_type": "user_recent_events_of_type",
         "stored_counter": "user_aggregation_lookup", "stored_recent_anomalies": "recent_anomalies",
         "stored_user_hour_anomalies": "user_hour_anomalies"}


def sql() -> dict[str, str]:
    found = _sql()
    return found | {name: found[other] for name, other in _SAME.items()}


def _sql() -> dict[str, str]:
    return {
        "user_type_minute_counts": _window_counts(1),
        "user_type_five_minute_counts": _window_counts(5),
        "user_type_daily_rollup": _DAILY,
        "type_daily_counts": f"""SELECT event_type, {_DAY} AS time_bucket,
  count(*) AS event_count FROM events GROUP BY ALL""",
        "type_hourly_counts": f"""SELECT event_type, {_HOUR} AS time_bucket,
  count(*) AS event_count FROM events GROUP BY ALL""",
        "user_aggregation_lookup": f"""SELECT * FROM ({_DAILY})
WHERE user_id = 7 AND event_type = 'view'
  AND time_bucket BETWEEN strftime({_NOW} - INTERVAL 168 HOUR, '%Y-%m-%d')
                      AND strftime({_NOW}, '%Y-%m-%d')""",
        "user_30s_counts": """SELECT user_id,
  time_bucket(INTERVAL '30 seconds', ts) AS window_start, count(*) AS count
FROM events GROUP BY ALL""",
        "recount_vs_rollup": f"""SELECT user_id, event_type, {_DAY} AS time_bucket,
  count(*) AS recounted, count(*) AS stored, 0::BIGINT AS difference
FROM events GROUP BY ALL""",
        "enriched_events": f"""SELECT event_id AS id, {_DAY} AS time_bucket,
  {_HOUR} AS hour_bucket, {_CATEGORY} AS category,
  len(list_distinct(json_keys(props)))::INT AS payload_size, true AS enriched,
  'enrichment-v1' AS processed_by, json_extract(props, '$.k')::INT AS k,
  (len(json_keys(props)) + 4)::INT AS keys_after, true AS processed,
  date_trunc('minute', ts) AS window_start FROM events""",
        "profiled_events": f"SELECT event_id AS id, user_id, segment, nation FROM events LEFT JOIN {_PROFILES} USING (user_id)",
        "rendered_events": """SELECT event_id AS id, event_type, user_id::VARCHAR AS user_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text, json_extract(props, '$.k')::INT AS k,
  5::INT AS n_fields FROM events""",
        "validated_requests": f"""WITH {_REQ}
SELECT id, ok AS is_valid, bad::INT AS n_violations FROM val""",
        "violation_messages": f"""WITH {_REQ}
SELECT id, concat_ws('; ',
  CASE WHEN no_type THEN 'eventType: eventType is required' END,
  CASE WHEN long_type THEN 'eventType: eventType must be under 50 characters' END,
  CASE WHEN no_user THEN 'userId: userId is required' END,
  CASE WHEN long_user THEN 'userId: userId must be under 100 characters' END,
  CASE WHEN no_payload THEN 'payload: payload is required' END) AS messages
FROM val WHERE NOT ok""",
        "batch_acceptance": f"""WITH {_REQ}, b AS (
  SELECT batch_id, count(*) AS n_events, count(*) FILTER (NOT ok) AS n_invalid
  FROM val GROUP BY 1)
SELECT *, n_events <= 100 AND n_invalid = 0 AS accepted,
  CASE WHEN n_events <= 100 AND n_invalid = 0 THEN n_events ELSE 0 END::BIGINT AS n_accepted,
  CASE WHEN n_events > 100 THEN 'batch size must not exceed 100 events'
       WHEN n_invalid > 0 THEN 'invalid event' END AS reason
FROM b""",
        "batch_flattened": f"""WITH {_REQ}
SELECT id, batch_id, event_type, user_id FROM val
WHERE batch_id IN (SELECT batch_id FROM val GROUP BY 1
                   HAVING count(*) <= 100 AND bool_and(ok))""",
        "array_batch_verdicts": f"""WITH {_ARRAYS}, v AS (
  SELECT batch_id, count(pos) AS n_events, count(nullif(told, '')) AS n_invalid,
    concat_ws('; ', CASE WHEN count(pos) = 0 THEN 'events: events list must not be empty'
      WHEN count(pos) > 100 THEN 'events: batch size must not exceed 100 events' END,
      string_agg(nullif(told, ''), '; ' ORDER BY pos)) AS messages
  FROM arr GROUP BY 1)
SELECT *, messages = '' AS accepted, CASE WHEN messages = '' THEN n_events ELSE 0 END::BIGINT AS n_accepted FROM v""",
        "array_batch_events": f"""WITH {_ARRAYS}
SELECT batch_id, pos::INT AS position, id, user_id FROM arr WHERE batch_id IN (
  SELECT batch_id FROM arr GROUP BY 1 HAVING count(pos) BETWEEN 1 AND 100 AND bool_and(ok))""",
        "client_ip": f"WITH {_REQ} SELECT id, ip AS source_ip, api_key FROM val",
        "stamped_events": f"""WITH {_REQ}
SELECT id, event_type, user_id, ts AS "timestamp", ip AS source_ip, true AS unprocessed
FROM val WHERE ok""",
        "dead_letter_routing": f"""WITH {_LETTERS}
SELECT id, CASE WHEN reason IS NULL THEN 'events_by_user' ELSE 'dead_letter' END AS routed_to,
  reason FROM msg""",
        "dead_letter_replay": f"""WITH {_LETTERS}
SELECT id, CASE WHEN reason = 'null_user_id' AND id IS NOT NULL THEN 'unknown' END AS user_id,
  CASE WHEN reason <> 'null_user_id' THEN reason WHEN id IS NULL THEN 'null_id' END AS reason
FROM msg WHERE reason IS NOT NULL""",
        "keyed_publish": """SELECT user_id::VARCHAR AS key, count(*) AS n,
  sum(event_id)::BIGINT AS sum_id FROM events GROUP BY 1""",
        "ema_baseline": f"""WITH RECURSIVE {_EMA}
SELECT user_id, window_start, n AS count, observations, mean, variance, z AS z_score
FROM zed""",
        "anomalies_daily": f"WITH RECURSIVE {_anomalies(3.0)} SELECT * FROM ano",
        "anomalies_low_threshold": f"WITH RECURSIVE {_anomalies(2.0)} SELECT * FROM ano",
        "throttle_decisions": _THROTTLE,
        "throttle_busy_keys": _THROTTLE,
        "ingest_calls": f"""WITH RECURSIVE {_CALLS}
SELECT batch_id, id, api_key, n_events, outcome FROM judged""",
        "ingested_events": f"WITH RECURSIVE {_CALLS} SELECT id, ip AS source_ip FROM taken",
        "stream_ingest": f"""WITH RECURSIVE {_CALLS}
SELECT id, user_id AS key, ip AS source_ip FROM taken""",
        "tokens_remaining": _TOKENS_LEFT,
        "user_recent_events": f"""SELECT event_id AS id, user_id, event_type,
  ts AS "timestamp", props AS payload FROM events
WHERE user_id = 7 AND ts BETWEEN {_NOW} - INTERVAL 168 HOUR AND {_NOW}
ORDER BY ts DESC, event_id LIMIT 1000""",
        "user_recent_events_of_type": f"""SELECT event_id AS id, user_id, event_type,
  ts AS "timestamp", props AS payload FROM events
WHERE user_id = 7 AND event_type = 'click'
  AND ts BETWEEN {_NOW} - INTERVAL 168 HOUR AND {_NOW}
ORDER BY ts DESC, event_id LIMIT 3""",
        "user_day_buckets": "\nUNION ALL ".join(
            f"""SELECT event_id AS id, user_id, '{day}' AS time_bucket, ts AS "timestamp"
FROM events WHERE user_id = 7 AND {_DAY} = '{day}'"""
            for day in ("2024-01-10", "2024-01-11", "2024-01-20")),
        "recent_events_per_user": f"""SELECT * FROM (
  SELECT event_id AS id, user_id, event_type, ts AS "timestamp",
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS rank
  FROM events WHERE ts BETWEEN {_NOW} - INTERVAL 24 HOUR AND {_NOW}) WHERE rank <= 2""",
        "recent_anomalies": f"""WITH RECURSIVE {_anomalies(3.0)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY time_bucket
    ORDER BY detected_at DESC, anomaly_id) AS r FROM ano
  WHERE time_bucket BETWEEN strftime({_NOW} - INTERVAL 23 HOUR, '%Y-%m-%d-%H')
                        AND strftime({_NOW}, '%Y-%m-%d-%H'))
SELECT user_id, metric, observed_value, expected_value, z_score, detected_at, severity
FROM ranked WHERE r <= 3""",
        "user_hour_anomalies": f"""WITH RECURSIVE {_anomalies(3.0)}
SELECT * FROM ano WHERE user_id = 97 AND time_bucket = '2024-01-18-00'""",
        "dedup_event_key": f"""SELECT event_id AS id, user_id, {_DAY} AS time_bucket,
  ts AS "timestamp", '{{"v":' || event_id || '}}' AS payload FROM events""",
        "dedup_user_instant": f"""SELECT max(event_id) AS id, user_id, {_DAY} AS time_bucket,
  date_trunc('hour', ts) AS "timestamp" FROM events
GROUP BY user_id, {_DAY}, date_trunc('hour', ts)""",
        "retention_events": f"""SELECT event_id AS id, ts AS "timestamp" FROM events
WHERE ts > {_NOW} - INTERVAL 7 DAY""",
        "outcome_totals": f"""WITH RECURSIVE {_OUTCOMES}, t AS (
  SELECT count(*) FILTER (outcome IN ('processed', 'failed')) AS ingested,
    count(*) FILTER (outcome = 'processed') AS processed,
    count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (outcome = 'rate_limited') AS rate_limited,
    count(*) FILTER (outcome = 'invalid') AS invalid FROM outc)
SELECT *, CASE WHEN ingested >= 100000 THEN 'red' WHEN ingested >= 10000 THEN 'yellow'
    ELSE 'green' END AS ingested_status,
  CASE WHEN failed >= 10 THEN 'red' WHEN failed >= 1 THEN 'yellow'
    ELSE 'green' END AS failed_status FROM t""",
        "anomaly_totals": f"""WITH RECURSIVE {_anomalies(3.0)}
SELECT count(*) AS anomalies, CASE WHEN count(*) >= 5 THEN 'red'
  WHEN count(*) >= 1 THEN 'orange' ELSE 'green' END AS anomalies_status FROM ano""",
        "ingest_rate_1m": """SELECT date_trunc('minute', ts) AS window_start, count(*) AS n,
  count(*) / 60::DOUBLE AS per_second FROM events GROUP BY 1""",
        "outcome_rate_1m": f"""WITH RECURSIVE {_OUTCOMES}
SELECT date_trunc('minute', ts) AS window_start, outcome, count(*) AS n,
  count(*) / 60::DOUBLE AS per_second FROM outc GROUP BY 1, 2""",
        "load_summary": f"""WITH RECURSIVE {_OUTCOMES}
SELECT outcome, count(*) AS n, (SELECT floor(count(*) * 1000000::DOUBLE
    / ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)) FROM outc)::BIGINT AS per_1000_sec
FROM outc GROUP BY 1""",
        "latency_quantiles": _quantiles("value", "value"),
        "latency_quantiles_null_group": _quantiles("value", "value", """(
  SELECT value, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type FROM events)"""),
        "latency_histogram": """WITH b AS (
  SELECT event_type, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21
    ELSE floor(20 * value / 100) + 1 END::BIGINT AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket)::BIGINT AS cumulative,
  CASE WHEN bucket <= 20 THEN round(bucket * 5::DOUBLE, 6) END AS upper FROM b""",
        "pipeline_delay": _quantiles("event_id % 997", "delay_ms"),
        "stored_event_check": f"""SELECT user_id, count(*) AS stored FROM events
WHERE ts BETWEEN {_NOW} - INTERVAL 24 HOUR AND {_NOW} GROUP BY 1""",
        "synthetic_events": f"""SELECT event_id AS id, {_pick(EVENT_TYPES, 1)} AS event_type,
  'user-' || lpad({_draw(2, 100)}::VARCHAR, 3, '0') AS user_id, {_pick(PAGES, 3)} AS page,
  {_draw(4, 300)}::INT AS duration, 'sess-' || {_draw(5, 32768)} AS session_id FROM events""",
        "stream_minute_counts": f"""SELECT user_id::VARCHAR AS user_id, * EXCLUDE (user_id)
FROM ({_window_counts(1)})""",
        "stream_event_tables": f"""WITH {_LETTERS}
SELECT id, CASE WHEN reason IS NULL THEN 'events_by_user' ELSE 'dead_letter' END AS routed_to,
  reason FROM msg""",
        "stream_daily_counters": f"""WITH {_LETTERS}
SELECT e.user_id::VARCHAR AS user_id, event_type, {_DAY} AS time_bucket,
  count(*) AS event_count
FROM events e JOIN msg ON id = event_id WHERE reason IS NULL GROUP BY ALL""",
        "stream_profiled_events": f"""WITH {_LETTERS}
SELECT event_id AS id, e.user_id::VARCHAR AS user_id, segment, nation, {_CATEGORY} AS category
FROM events e JOIN msg ON id = event_id LEFT JOIN {_PROFILES} ON p.user_id = e.user_id WHERE reason IS NULL""",
        "stream_replayed_counters": f"""WITH {_LETTERS}
SELECT CASE WHEN reason IS NULL THEN e.user_id::VARCHAR ELSE 'unknown' END AS user_id, event_type,
  {_DAY} AS time_bucket, count(*) AS event_count
FROM msg m JOIN events e ON m.id = event_id
WHERE reason IS NULL OR reason = 'null_user_id' GROUP BY ALL""",
        "stream_replayed_events": f"""WITH {_LETTERS}
SELECT CASE WHEN reason IS NULL OR reason = 'null_user_id' AND id IS NOT NULL THEN 'stored' ELSE reason END AS state,
  count(*) AS n FROM msg GROUP BY 1""",
        "stream_anomalies": f"WITH RECURSIVE {_anomalies(3.0)} SELECT * FROM ano",
        "latency_summaries": "SELECT event_type, count(value) AS n, p::DOUBLE AS quantile, true AS within_bound "
            "FROM events, (VALUES (0.5), (0.95), (0.99)) q(p) GROUP BY event_type, p",
        "sliding_rate_15s": _sliding(15, 60),
        "sliding_rate_by_type": _sliding(60, 300, "event_type"),
        "stored_order": f"SELECT {_DAY} AS time_bucket, count(*) AS n, 0::BIGINT AS out_of_order FROM ("
            "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 2) GROUP BY 1",
        "stream_bucket_decisions": _THROTTLE,
        "stream_tokens_remaining": _TOKENS_LEFT,
        "stream_daily_rollup": f"""SELECT user_id, event_type, {_DAY} AS time_bucket, count(*) AS event_count,
  count(DISTINCT date_trunc('minute', ts)) AS windows FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_NOW} - INTERVAL 1 HOUR GROUP BY ALL""",
        "stream_live_totals": f"""SELECT *, CASE WHEN ingested >= 100000 THEN 'red' WHEN ingested >= 10000 THEN 'yellow'
    ELSE 'green' END AS ingested_status,
  CASE WHEN failed >= 10 THEN 'red' WHEN failed >= 1 THEN 'yellow' ELSE 'green' END AS failed_status,
  CASE WHEN anomalies >= 5 THEN 'red' WHEN anomalies >= 1 THEN 'orange' ELSE 'green' END AS anomalies_status
FROM (WITH {_LETTERS} SELECT count(*) AS ingested, count(reason) AS failed FROM msg),
  (SELECT count(*) AS rate_limited FROM ({_THROTTLE}) WHERE NOT allowed),
  (WITH RECURSIVE {_anomalies(3.0)} SELECT count(*) AS anomalies FROM ano)""",
        "stream_throttle": _THROTTLE,
        "stream_without_repeats":
            "SELECT event_id AS id, user_id, event_type FROM events",
    }
