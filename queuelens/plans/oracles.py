"""SQL counterpart of every registered query, for an independent engine.

Each statement derives its tables from the given ones and is, where that is
possible, worded in another way than the operator: intervals joined to ticks
instead of running totals, self-joins instead of window functions, and so on.
"""

# Fixed values, stated here once more so that a slip in the code shows: keep the ten latest;
# messages 4 days, dead letters 14 days, untagged versions 1 day; and what the queries ask for.
KEEP = 10
MESSAGE_RETENTION, DEAD_LETTER_RETENTION, UNTAGGED_RETENTION = 345600, 1209600, 86400
DOCUMENT_LIMIT = 2000
AS_OF, UNTAGGED_AS_OF = "2024-01-14 12:00:00", "1998-01-01 00:00:00"

EV = """
ev AS (
  SELECT event_id, event_type AS queue, ts, props, user_id,
         (event_id * 7919) % (1 + 60 * (day(ts) % 5)) AS delay_min,
         CASE WHEN event_id % 50 = 13 THEN NULL WHEN event_id % 10 < 7 THEN 1
              WHEN event_id % 10 < 9 THEN 2 ELSE 3 END AS ok_at,
         100 + event_id % 400 AS work_ms
  FROM events)"""

RECEIVES = EV + """,
receives AS (
  SELECT queue, event_id AS message_id, CAST(k AS INTEGER) AS receive_count,
         'r-' || event_id || '-' || k AS receipt_handle,
         ts + to_minutes(CAST(delay_min + 30 * (k - 1) AS INTEGER)) AS received_at,
         ok_at, work_ms, ts AS sent_at
  FROM ev, (SELECT unnest([1, 2, 3]) AS k)
  WHERE k <= coalesce(ok_at, 3))"""

ACKS = RECEIVES + """,
acks AS (
  SELECT queue, message_id, receipt_handle, received_at + to_milliseconds(work_ms) AS acked_at, FALSE AS stale
  FROM receives WHERE receive_count = ok_at
  UNION ALL
  SELECT queue, message_id, receipt_handle, received_at + to_minutes(31), TRUE
  FROM receives WHERE receive_count = 1 AND message_id % 100 = 57)"""

DEAD = RECEIVES + """,
dead AS (
  SELECT queue, message_id, received_at, received_at + to_minutes(30) AS dead_at
  FROM receives WHERE ok_at IS NULL AND receive_count = 3)"""


def tick(ts: str) -> str:
    return f"((epoch_us({ts}) + 899999999) // 900000000)"


GRID = f"""
grid AS (
  SELECT queue, tick FROM (SELECT DISTINCT event_type AS queue FROM events),
         (SELECT unnest(range((SELECT min({tick("ts")}) FROM events),
            (SELECT max({tick("greatest(received_at + to_minutes(30), received_at + to_minutes(CASE WHEN message_id % 100 = 57 AND receive_count = 1 THEN 31 ELSE 0 END))")}) + 1 FROM receives))) AS tick))"""

# A message waits from when it is sent to its first receive; between later
# receives it is shown again at the very moment it is received.
WAITING = RECEIVES + f""",
waiting AS (
  SELECT queue, {tick("sent_at")} AS from_tick, {tick("received_at")} AS to_tick
  FROM receives WHERE receive_count = 1
  UNION ALL
  SELECT a.queue, {tick("a.received_at + to_minutes(30)")}, {tick("b.received_at")}
  FROM receives a JOIN receives b ON a.message_id = b.message_id AND b.receive_count = a.receive_count + 1)"""

PRESENT = RECEIVES + f""",
waiting AS (
  SELECT queue, {tick("sent_at")} AS from_tick,
         CASE WHEN ok_at IS NULL THEN {tick("received_at + to_minutes(30)")}
              ELSE {tick("received_at + to_milliseconds(work_ms)")} END AS to_tick
  FROM receives WHERE receive_count = coalesce(ok_at, 3))"""

COUNTED = """,
depth AS (
  SELECT g.queue, g.tick, count(w.from_tick) AS depth
  FROM grid g LEFT JOIN waiting w ON w.queue = g.queue AND w.from_tick <= g.tick AND g.tick < w.to_tick
  GROUP BY ALL)"""

DEPTH = WAITING + "," + GRID + COUNTED

RECOMMENDED = DEPTH + """,
  wanted AS (SELECT *, CAST(least(ceil(depth / 5), 5) AS BIGINT) AS desired FROM depth),
  recent AS (
    SELECT w.queue, w.tick, w.depth, w.desired, max(p.desired) AS stabilized,
           max(CASE WHEN p.tick > w.tick - 2 THEN p.depth END) AS lately
    FROM wanted w JOIN wanted p ON p.queue = w.queue AND p.tick BETWEEN w.tick - 2 AND w.tick
    GROUP BY ALL),
recommended AS (
  SELECT queue, tick, depth, desired, stabilized,
         CASE WHEN depth = 0 AND lately > 0 AND stabilized < 1 THEN 1 ELSE stabilized END AS replicas
  FROM recent)"""

ENVELOPES = """
env AS (
  SELECT event_id, ts, event_type AS queue, 100 + event_id % 400 AS work_ms,
         CASE WHEN event_id % 41 <> 0 THEN CAST(event_id AS VARCHAR) END AS message_id,
         'r-' || event_id || '-1' AS receipt_handle,
         CASE WHEN event_id % 53 <> 0 THEN props END AS body,
         CASE WHEN event_id % 43 = 0 THEN 'x' WHEN event_id % 47 = 0 THEN NULL ELSE '1' END AS receive_count_text
  FROM events)"""

NORMAL = ENVELOPES + """,
normal AS (
  SELECT event_id, ts, queue, work_ms, ifnull(message_id, 'unknown') AS message_id, receipt_handle,
         ifnull(body, '') AS body, ifnull(TRY_CAST(receive_count_text AS INTEGER), 1) AS receive_count,
         ifnull(receive_count_text, '1') = 'x' AS bad_receive_count, receive_count_text,
         queue <> 'error' AS success,
         CASE WHEN queue = 'error' THEN 'cannot handle error events' END AS error,
         CASE WHEN queue = 'error' THEN 'ValueError' END AS error_type,
         ifnull(TRY_CAST(regexp_extract(body, '([0-9]+)', 1) AS INTEGER), 0) >= 90 AS odd
  FROM env)"""


def log_row(level: str, message: str, where: str = "TRUE", **extras: str) -> str:
    kinds = {
        "receive_count": "INTEGER",
        "body_length": "INTEGER",
        "body": "VARCHAR",
        "duration_ms": "DOUBLE",
        "error": "VARCHAR",
        "error_type": "VARCHAR",
    }
    rest = ", ".join(f"CAST({extras.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in kinds.items())
    return (
        f"SELECT ts AS asctime, 'queue' AS name, '{level}' AS levelname, {message} AS message, "
        f"message_id, {rest} FROM normal WHERE {where}"
    )


LOG = NORMAL + ",\nlog AS (\n" + "\nUNION ALL\n".join(
    [
        log_row("INFO", "'Processing message'", receive_count="receive_count", body_length="length(body)"),
        log_row("INFO", "'Received message: ' || body", body="body"),
        log_row("INFO", "'Message processed successfully'", "success", duration_ms="work_ms"),
        log_row(
            "ERROR",
            "'Message processing failed'",
            "NOT success",
            receive_count="receive_count",
            duration_ms="work_ms",
            error="error",
            error_type="error_type",
        ),
        log_row("DEBUG", "'Message deleted from queue'", "success"),
        log_row("WARNING", "'Message not deleted — will retry or go to DLQ'", "NOT success"),
    ]
) + ")"

RECORDS = """
records AS (
  SELECT ts AS asctime, props AS message, CAST(event_id AS VARCHAR) AS message_id,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING'
                         WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS levelname,
         CAST(100 + event_id % 400 AS DOUBLE) AS duration_ms
  FROM events)"""

GENERATED = """
seen AS (SELECT count(*) AS total, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp,
                date_trunc('second', max(ts)) AS ts FROM events),
generated AS (
  SELECT n, CAST(ceil(n / 10) AS BIGINT) AS batch, 'msg-' || n AS entry_id,
         'demo-message-' || n || ' | batch=' || CAST(ceil(n / 10) AS BIGINT) || ' | ts=' || stamp
           || ' | total=' || total AS body, ts, total
  FROM (SELECT unnest(range(1, (SELECT total FROM seen) + 1)) AS n), seen)"""

POLLS = """
polls AS (
  SELECT user_id AS consumer, ts AS polled_at,
         CASE WHEN event_type = 'error' THEN 'api_error' WHEN event_type IN ('view', 'click') THEN 'empty'
              ELSE 'got' END AS kind,
         CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE 1 + event_id % 10 END AS n_messages
  FROM events)"""

STREAKS = """
islands AS (SELECT *, count(*) FILTER (kind = 'got')
              OVER (PARTITION BY consumer ORDER BY polled_at, kind, n_messages) AS island FROM polls),
streaks AS (SELECT *, count(*) FILTER (kind = 'empty')
              OVER (PARTITION BY consumer, island ORDER BY polled_at, kind, n_messages) AS streak FROM islands)"""

VERSIONS = """
versions AS (
  SELECT o_orderpriority AS repo, o_orderkey AS id, o_orderdate AS pushed_at,
         CASE o_orderkey % 4 WHEN 0 THEN 'v' || o_orderkey WHEN 1 THEN 'sha-' || o_orderkey
                             WHEN 2 THEN 'tmp-' || o_orderkey END AS tag
  FROM orders)"""

ALARMS = DEAD + "," + GRID + f""",
gauge AS (
  SELECT g.queue, g.tick, count(d.message_id) AS visible
  FROM grid g LEFT JOIN dead d ON d.queue = g.queue
       AND {tick("d.dead_at")} <= g.tick AND g.tick < {tick("d.dead_at + to_hours(6)")}
  GROUP BY ALL),
alarms AS (
  SELECT queue || '-dlq' AS queue, make_timestamp(tick // 4 * 3600000000) AS window_start,
         make_timestamp((tick // 4 + 1) * 3600000000) AS window_end,
         CAST(sum(visible) AS BIGINT) AS total, sum(visible) > 1 AS alarm
  FROM gauge GROUP BY queue, tick // 4)"""

STATES = ACKS + f""",
seen AS (SELECT * FROM receives WHERE received_at <= TIMESTAMP '{AS_OF}'),
states AS (
  SELECT e.queue, e.event_id AS message_id, e.ts AS sent_at,
         (SELECT max(received_at) FROM seen s WHERE s.message_id = e.event_id) AS last_received_at,
         CAST((SELECT count(*) FROM seen s WHERE s.message_id = e.event_id) AS INTEGER) AS receive_count,
         CASE WHEN e.event_id IN (SELECT message_id FROM acks WHERE NOT stale AND acked_at <= TIMESTAMP '{AS_OF}')
                THEN 'DELETED'
              WHEN e.event_id IN (SELECT message_id FROM receives WHERE ok_at IS NULL AND receive_count = 3
                                  AND received_at + to_minutes(30) <= TIMESTAMP '{AS_OF}') THEN 'DEAD'
              WHEN e.event_id IN (SELECT message_id FROM seen
                                  WHERE received_at + to_minutes(30) > TIMESTAMP '{AS_OF}') THEN 'IN_FLIGHT'
              ELSE 'VISIBLE' END AS state
  FROM ev e WHERE e.ts <= TIMESTAMP '{AS_OF}')"""

ODD_CUSTOMER = """
SELECT c_custkey, concat_ws(',',
    CASE WHEN coalesce(trim(c_name), '') = '' THEN 'c_name_required' END,
    CASE WHEN coalesce(c_name LIKE '%REPLACE%', TRUE) THEN 'c_name_placeholder' END,
    CASE WHEN NOT coalesce(length(c_name) <= 20, FALSE) THEN 'c_name_length' END,
    CASE WHEN NOT coalesce(regexp_full_match(c_name, 'Customer#[0-9]+'), FALSE) THEN 'c_name_pattern' END,
    CASE WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), FALSE)
         THEN 'c_mktsegment_member' END,
    CASE WHEN NOT coalesce(c_acctbal >= 0 AND c_acctbal <= 9000, FALSE) THEN 'c_acctbal_range' END,
    CASE WHEN NOT coalesce(length(c_name) - length(replace(c_name, '#', '')) = 1, FALSE)
         THEN 'name_parts_size' END) AS violations
FROM customer"""

SCAN = f"WITH {ENVELOPES} SELECT message_id, receipt_handle, body, receive_count_text FROM env"
OUTCOMES = f"WITH {NORMAL} SELECT event_id, message_id, success, error, error_type FROM normal"

ORACLES = {
    "message_scan": SCAN,
    "bounded_stream_scan": SCAN,
    "bounded_polls": SCAN.replace("SELECT message_id", "SELECT TRUE AS bounded, message_id"),
    "message_generator": f"WITH {GENERATED} SELECT n, batch, entry_id, body FROM generated",
    "structured_log_sink": f"""WITH {LOG}
        SELECT '{{' || concat_ws(',',
            '"asctime":"' || strftime(asctime, '%Y-%m-%dT%H:%M:%S') || '"',
            '"name":"' || name || '"', '"levelname":"' || levelname || '"',
            '"message":' || CAST(to_json(message) AS VARCHAR), '"message_id":"' || message_id || '"',
            '"receive_count":' || receive_count, '"body_length":' || body_length,
            '"body":' || CAST(to_json(body) AS VARCHAR), '"duration_ms":' || duration_ms,
            '"error":"' || error || '"', '"error_type":"' || error_type || '"') || '}}' AS line
        FROM log""",
    "structured_log_source": f"""WITH {LOG}
        SELECT * REPLACE (date_trunc('second', asctime) AS asctime) FROM log""",
    "route_sink": f"""WITH {NORMAL}
        SELECT message_id, receipt_handle, CASE WHEN odd THEN 'retry' ELSE 'ack' END AS route,
               CASE WHEN odd THEN '2' ELSE receive_count_text END AS receive_count_text,
               NOT odd AS success, CASE WHEN odd THEN 'ValueError' END AS error_type
        FROM normal""",
    "normalize_messages": f"""WITH {NORMAL}
        SELECT event_id, message_id, receipt_handle, body, receive_count, bad_receive_count,
               CAST(length(body) AS INTEGER) AS body_length FROM normal""",
    "process_messages": OUTCOMES,
    "process_messages_python": OUTCOMES,
    "route_outcomes": f"""WITH {RECEIVES}
        SELECT queue, message_id, receive_count,
               CASE WHEN ok_at = receive_count THEN 'ack' WHEN receive_count = 3 THEN 'dead' ELSE 'retry' END AS route
        FROM receives""",
    "log_threshold": f"""WITH {RECORDS}
        SELECT asctime, levelname, message, message_id FROM records WHERE levelname IN ('ERROR', 'WARNING')""",
    "log_store_query": f"""WITH {RECORDS}
        SELECT asctime, message, message_id, duration_ms FROM records
        WHERE levelname = 'ERROR' AND asctime >= '2024-01-08 06:00:00' AND asctime < '2024-01-15 06:00:00'
        ORDER BY asctime DESC, message_id""",
    "log_query": f"""WITH {RECORDS}
        SELECT asctime, message, message_id, duration_ms FROM records WHERE levelname = 'ERROR'
        ORDER BY asctime DESC, message_id""",
    "log_query_latest": f"""WITH {RECORDS}
        SELECT asctime, message, message_id, duration_ms FROM records WHERE levelname = 'ERROR'
        ORDER BY asctime DESC, message_id LIMIT 100""",
    "message_log": f"WITH {LOG} SELECT * FROM log",
    "constraint_check": f"SELECT *, violations = '' AS is_valid FROM ({ODD_CUSTOMER})",
    "address_ranges": """
        WITH named AS (
          SELECT c_custkey, 10 + c_custkey % 3 AS a, c_custkey % 5 AS b, (c_custkey * 7) % 256 AS c, (c_custkey * 31) % 256 AS d,
                 CASE WHEN c_custkey % 50 = 0 THEN 8 ELSE 18 + c_custkey % 15 END AS prefix,
                 c_custkey % 41 <> 0 AND c_custkey % 43 <> 0 AS is_valid
          FROM customer),
        blocks AS (
          SELECT c_custkey, is_valid,
                 CASE WHEN c_custkey % 41 = 0 THEN '' WHEN c_custkey % 43 = 0 THEN '300.' ELSE '' END || concat_ws('.', a, b, c, d)
                   || CASE WHEN c_custkey % 41 = 0 THEN '' ELSE '/' || prefix END AS block,
                 ((CAST(a AS BIGINT) * 256 + b) * 256 + c) * 256 + d AS number, CAST(1 AS BIGINT) << (32 - prefix) AS size
          FROM named),
        sized AS (SELECT *, number // size * size AS low, number // size * size + size - 1 AS high FROM blocks),
        ranges AS (
          SELECT s_suppkey, 167772160 + (CAST(s_suppkey AS BIGINT) * 7919993) % 50331648 AS range_low,
                 (CAST(s_suppkey AS BIGINT) * s_suppkey * 37) % 200000 AS width
          FROM supplier)
        SELECT c_custkey, any_value(block) AS block, any_value(is_valid) AS is_valid, count(s_suppkey) AS overlapping,
               count(*) FILTER (range_low <= low AND high <= range_low + width) AS containing, min(s_suppkey) AS first_range
        FROM sized LEFT JOIN ranges ON is_valid AND range_low <= high AND low <= range_low + width
        GROUP BY c_custkey""",
    "parse_body": f"""WITH {GENERATED}
        SELECT body, n, batch, ts, total FROM generated
        UNION ALL SELECT props, NULL, NULL, NULL, NULL FROM events""",
    "body_size": f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS n_characters,
               CAST(strlen(text) AS INTEGER) AS n_bytes, strlen(text) > {DOCUMENT_LIMIT} AS too_large
        FROM documents""",
    "processing_duration": """SELECT event_id,
            round(epoch_us(ts + to_milliseconds(100 + event_id % 400)) / 1000.0 - epoch_us(ts) / 1000.0, 2)
              AS duration_ms
        FROM events""",
    "ack_join": f"""WITH {ACKS}
        SELECT r.queue, r.message_id, r.receive_count, r.receipt_handle, r.received_at, a.acked_at,
               n.received_at AS next_received_at, ifnull(a.stale, FALSE) AS stale_ack
        FROM receives r LEFT JOIN acks a USING (receipt_handle)
             LEFT JOIN receives n ON n.message_id = r.message_id AND n.receive_count = r.receive_count + 1""",
    "pending_messages": f"""WITH {ACKS}
        SELECT event_type AS queue, event_id AS message_id, ts AS sent_at, props AS body FROM events
        WHERE NOT EXISTS (SELECT 1 FROM acks WHERE NOT stale AND message_id = event_id)""",
    "policy_join": f"""WITH {DEPTH}
        SELECT env, queue, tick, depth, 0 AS min_replicas, max_replicas, poll_s, cooldown_s,
               30 AS stabilization_s, 5 AS queue_length, FALSE AS in_flight,
               CAST(least(ceil(depth / 5), max_replicas) AS BIGINT) AS desired
        FROM depth JOIN (VALUES ('click', 'dev', 3, 10, 15), ('view', 'dev', 3, 10, 15),
                                ('error', 'prod', 5, 15, 30), ('signup', 'prod', 5, 15, 30),
                                ('purchase', 'prod', 5, 15, 30))
             p(queue, env, max_replicas, poll_s, cooldown_s) USING (queue)""",
    "queue_depth": f"""WITH {STATES}
        SELECT queue, count(*) FILTER (state = 'VISIBLE') AS visible,
               count(*) FILTER (state = 'IN_FLIGHT') AS in_flight,
               count(*) FILTER (state = 'DELETED') AS deleted, count(*) FILTER (state = 'DEAD') AS dead
        FROM states GROUP BY queue""",
    "send_summary": """
        WITH results AS (SELECT CASE WHEN event_id % 91 <> 0 THEN event_id // 10 + 1 END AS batch, event_id % 37 = 0 AS bad FROM events)
        SELECT batch, count(*) FILTER (NOT bad) AS sent, count(*) FILTER (bad) AS failed, CAST(1 AS BIGINT) AS batches,
               FALSE AS is_total
        FROM results GROUP BY batch
        UNION ALL
        SELECT NULL, count(*) FILTER (NOT bad), count(*) FILTER (bad), count(DISTINCT coalesce(batch, -1)), TRUE FROM results""",
    "send_prediction": """
        SELECT count(*) FILTER (event_id % 37 <> 0) AS sent, count(*) FILTER (event_id % 37 = 0) AS failed,
               CAST(least(ceil(count(*) FILTER (event_id % 37 <> 0) / 5), 5) AS BIGINT) AS replicas
        FROM events""",
    "poll_log": f"""WITH {POLLS}, {STREAKS}
        SELECT polled_at AS asctime, 'queue' AS name, CASE kind WHEN 'empty' THEN 'DEBUG' ELSE 'ERROR' END AS levelname,
               CASE kind WHEN 'empty' THEN 'No messages received (queue may be empty)'
                         ELSE 'SQS API error during receive' END AS message,
               CASE kind WHEN 'empty' THEN streak END AS empty_poll_count
        FROM streaks WHERE kind <> 'got'""",
    "outcome_summary": f"""WITH {NORMAL}
        SELECT queue, count(*) FILTER (success) AS processed, count(*) FILTER (NOT success) AS failed,
               CAST(sum(work_ms) * 100 AS BIGINT) / (count(*) * 100) AS avg_duration_ms,
               CAST(max(work_ms) AS DOUBLE) AS max_duration_ms
        FROM normal GROUP BY queue""",
    "retry_profile": """
        SELECT CAST(CASE WHEN event_id % 50 = 13 THEN 3 WHEN event_id % 10 < 7 THEN 1
                         WHEN event_id % 10 < 9 THEN 2 ELSE 3 END AS INTEGER) AS receive_count,
               count(*) AS messages
        FROM events GROUP BY 1""",
    "dead_letters": f"""WITH {DEAD}
        SELECT queue, message_id, queue || '-dlq' AS dead_letter_queue, CAST(3 AS INTEGER) AS receive_count,
               received_at AS last_received_at, dead_at FROM dead""",
    "dead_letter_alarm": f"WITH {ALARMS} SELECT * FROM alarms",
    "dead_letter_alarm_stream": f"""WITH {ALARMS}
        SELECT * FROM alarms""",
    "poll_profile": f"""WITH {POLLS}
        SELECT time_bucket(INTERVAL '1 hour', polled_at) AS hour, consumer, count(*) AS polls,
               count(*) FILTER (kind = 'empty') AS empty_polls,
               count(*) FILTER (kind = 'api_error') AS api_errors,
               CAST(sum(n_messages) AS BIGINT) AS messages
        FROM polls GROUP BY 1, 2""",
    "attempt_number": f"""WITH {RECEIVES}
        SELECT queue, message_id, receipt_handle, received_at, CAST(receive_count AS BIGINT) AS attempt
        FROM receives""",
    "message_state": f"""WITH {STATES}
        SELECT queue, message_id, sent_at, last_received_at, receive_count, state,
               receive_count >= 2 AS redelivered,
               CASE WHEN state = 'IN_FLIGHT' THEN last_received_at + to_minutes(30) END AS visible_again_at
        FROM states""",
    "depth_series": f"WITH {DEPTH} SELECT queue, tick, depth FROM depth",
    "depth_series_in_flight": f"WITH {PRESENT}, {GRID} {COUNTED} SELECT queue, tick, depth FROM depth",
    "empty_poll_streak": f"WITH {POLLS}, {STREAKS} SELECT consumer, polled_at, kind, n_messages, streak FROM streaks",
    "replica_recommendation": f"WITH {RECOMMENDED} SELECT queue, tick, depth, desired, stabilized, replicas FROM recommended",
    "replica_rate_limits": f"""WITH RECURSIVE {RECOMMENDED},
        numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY tick) AS i FROM recommended),
        walk AS (
          SELECT DISTINCT queue, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS workers, CAST(0 AS BIGINT) AS earlier FROM numbered
          UNION ALL
          SELECT n.queue, n.i,
                 CASE WHEN n.replicas > w.workers THEN least(n.replicas, w.workers + 1)
                      WHEN n.replicas < w.workers THEN greatest(n.replicas, least(w.earlier * 50 // 100, w.workers))
                      ELSE w.workers END, w.workers
          FROM walk w JOIN numbered n ON n.queue = w.queue AND n.i = w.i + 1)
        SELECT queue, tick, depth, desired, stabilized, replicas, workers AS limited FROM numbered JOIN walk USING (queue, i)""",
    "replica_recommendation_by_env": f"""WITH {DEPTH},
        policy AS (SELECT * FROM (VALUES ('click', 'dev', 3, 1), ('view', 'dev', 3, 1), ('error', 'prod', 5, 2),
                     ('signup', 'prod', 5, 2), ('purchase', 'prod', 5, 2)) p(queue, env, most, cool_ticks)),
        wanted AS (SELECT *, CAST(least(ceil(depth / 5), most) AS BIGINT) AS desired FROM depth JOIN policy USING (queue)),
        recent AS (
          SELECT w.queue, w.env, w.tick, w.depth, w.desired, max(p.desired) AS stabilized,
                 max(CASE WHEN p.tick > w.tick - w.cool_ticks THEN p.depth END) AS lately
          FROM wanted w JOIN wanted p ON p.queue = w.queue AND p.tick BETWEEN w.tick - 2 AND w.tick
          GROUP BY ALL)
        SELECT env, queue, tick, depth, desired, stabilized,
               CASE WHEN depth = 0 AND lately > 0 AND stabilized < 1 THEN 1 ELSE stabilized END AS replicas
        FROM recent""",
    "change_detection": """
        WITH v AS (SELECT *, md5('{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}') AS fingerprint,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
        SELECT a.o_orderkey, a.o_custkey, a.fingerprint, a.fingerprint IS DISTINCT FROM b.fingerprint AS changed
        FROM v a LEFT JOIN v b ON b.o_custkey = a.o_custkey AND b.rn = a.rn - 1""",
    "batch_assignment": """
        SELECT event_type AS queue, event_id AS message_id, ts AS sent_at,
               (count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) + 9) // 10 AS batch
        FROM events""",
    "retention_rules": f"""WITH {VERSIONS},
        claimed AS (
          SELECT *, CAST(CASE WHEN tag LIKE 'v%' THEN 1 WHEN tag LIKE 'sha-%' THEN 2 ELSE 3 END AS INTEGER) AS rule FROM versions)
        SELECT *, CASE rule WHEN 3 THEN epoch_us(TIMESTAMP '{UNTAGGED_AS_OF}') - epoch_us(pushed_at) > CAST(200 * 86400 AS BIGINT) * 1000000
                  ELSE row_number() OVER (PARTITION BY repo, rule ORDER BY pushed_at DESC, id DESC) > CASE rule WHEN 1 THEN 500 ELSE 300 END
                  END AS expire
        FROM claimed""",
    "retain_latest": f"""WITH {VERSIONS}
        SELECT *, count(*) FILTER (tag LIKE 'v%' OR tag LIKE 'sha-%' OR tag LIKE 'latest%')
                    OVER (PARTITION BY repo ORDER BY pushed_at DESC, id DESC) > {KEEP}
                  AND ifnull(tag LIKE 'v%' OR tag LIKE 'sha-%' OR tag LIKE 'latest%', FALSE) AS expire
        FROM versions""",
    "expire_messages": f"""
        SELECT event_type AS queue, event_id AS message_id, ts AS sent_at,
               epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) > CAST({MESSAGE_RETENTION} AS BIGINT) * 1000000 AS expire
        FROM events""",
    "expire_dead_letters": f"""WITH {DEAD}
        SELECT queue, message_id, dead_at,
               epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(dead_at) > CAST({DEAD_LETTER_RETENTION} AS BIGINT) * 1000000 AS expire
        FROM dead""",
    "expire_untagged": f"""WITH {VERSIONS}
        SELECT *, tag IS NULL AND epoch_us(TIMESTAMP '{UNTAGGED_AS_OF}') - epoch_us(pushed_at) > CAST({UNTAGGED_RETENTION} AS BIGINT) * 1000000 AS expire
        FROM versions""",
    "replica_formula": """
        SELECT o_custkey, count(*) AS depth, CAST(least(ceil(count(*) / 5), 5) AS BIGINT) AS replicas
        FROM orders GROUP BY o_custkey""",
    "queue_names": """
        WITH named AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name)
            ELSE lower(c_mktsegment) || '-' || c_nationkey || '-queue' END AS queue FROM customer)
        SELECT c_custkey, queue, queue || '-dlq' AS dead_letter_queue FROM named""",
    # A body that cannot be processed is never deleted. A handle ends in the first number of its message; 7 and 9 have no common
    # factor, so three messages of 63 fail for good.
    "failed_deletes": f"""WITH {NORMAL},
        settled AS (
          SELECT *, event_id % 7 = 3 AS clings, event_id % 7 = 3 AND event_id % 9 = 0 AS stays FROM normal)
        SELECT message_id, receipt_handle,
               CAST(CASE WHEN odd OR stays THEN 3 WHEN clings AND receive_count = 1 THEN 2 ELSE receive_count END AS INTEGER) AS receive_count,
               CASE WHEN odd OR stays THEN 'dead' ELSE 'ack' END AS route, NOT odd AS success
        FROM settled""",
    "consumer_rounds": f"""WITH {NORMAL}
        SELECT message_id, receipt_handle, CAST(CASE WHEN odd THEN 3 ELSE receive_count END AS INTEGER)
                 AS receive_count, CASE WHEN odd THEN 'dead' ELSE 'ack' END AS route
        FROM normal""",
    "stateful_retry": f"""WITH {RECEIVES}
        SELECT queue, message_id, receipt_handle, receive_count,
               CASE WHEN receive_count = 3 THEN 'dead' ELSE 'retry' END AS route
        FROM receives WHERE ok_at IS NULL OR receive_count < ok_at""",
    "stateful_retry_any_order": f"""WITH {RECEIVES}
        SELECT queue, message_id, receipt_handle, receive_count,
               CASE WHEN receive_count = 3 THEN 'dead' ELSE 'retry' END AS route
        FROM receives WHERE ok_at IS NULL OR receive_count < ok_at""",
    "redelivery_dedup": f"""WITH {RECEIVES}
        SELECT queue, message_id, min(received_at) AS received_at, min_by(receipt_handle, received_at) AS receipt_handle
        FROM receives GROUP BY queue, message_id""",
}
