"""Every registered query: name -> function of (spark, folder of the given tables)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.functions.bodies import TIME_FORMAT
from queuelens.functions.handlers import outcome, python_handler
from queuelens.functions.scalars import dead_letter_name, desired_replicas, queue_name, tick_time
from queuelens.operators import addresses, alarm, depth, lifecycle, limits, logs, messages, polls, retention, rules, scaling, sending
from queuelens.operators.skew import ROWS_PER_TASK
from queuelens.plans import tables as t
from queuelens.schemas import ENVELOPE
from queuelens.session import configure, is_small, scratch, stored
from queuelens.sources import generator, log_store, sinks
from queuelens.sources.messages import read_log, read_messages, stream_messages
from queuelens.sources.polls import MOST_PER_POLL, POLLED, stream_polls
from queuelens.streaming.alarm import dlq_alarm_stream, read_alarms
from queuelens.streaming.consume import consume, consume_rounds
from queuelens.streaming.dedup import dedup_messages, first_deliveries
from queuelens.streaming.retry import read_decisions, retry_state
from queuelens.streaming.running import drained
from queuelens.streaming.runs import latest_decisions, retry_in_any_order

Query = Callable[[SparkSession, str], DataFrame]

DOCUMENT_LIMIT = 2_000
UNTAGGED_AS_OF = "1998-01-01 00:00:00"
LATENESS = "6 hours"
DELAY_S = 86_400
LOG_WEEK = ("2024-01-08 06:00:00", "2024-01-15 06:00:00")
OTHER_FIELDS = ["error_code", "empty_poll_count", "exc_info"]  # of records of polls, and of Python handlers

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _text_columns(df: DataFrame, *others: Column) -> DataFrame:
    """Envelope columns with the receive count instead of the attribute map."""
    return df.select(
        "message_id",
        "receipt_handle",
        "body",
        F.col("attributes")[messages.RECEIVE_COUNT].alias("receive_count_text"),
        *others,
    )


def _stored_envelopes(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "envelopes")
    t.envelopes(spark, sf_dir).select(*ENVELOPE.names).write.parquet(path)
    return path


# Sources and sinks


@query
def message_scan(spark, sf_dir):
    return _text_columns(read_messages(spark, _stored_envelopes(spark, sf_dir)))


@query
def bounded_stream_scan(spark, sf_dir):
    src, out = _stored_envelopes(spark, sf_dir), scratch(spark, "scanned")
    # As many files at once as there are tasks at once.
    stream = stream_messages(spark, src, max_per_trigger=spark.sparkContext.defaultParallelism)
    drained(
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    return _text_columns(read_messages(spark, out))


def _generated(spark, sf_dir) -> DataFrame:
    """One generated message per event, all stamped with the last event time."""
    seen = (
        t.table(spark, sf_dir, "events")
        .agg(F.count("*").alias("n"), F.date_format(F.max("ts"), TIME_FORMAT).alias("ts"))
        .first()
    )
    return generator.generate_messages(spark, seen["ts"], seen["n"])


@query
def message_generator(spark, sf_dir):
    return _generated(spark, sf_dir)


@query
def structured_log_sink(spark, sf_dir):
    path = scratch(spark, "log")
    sinks.write_log(_consumer_log(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def structured_log_source(spark, sf_dir):
    path = scratch(spark, "log")
    sinks.write_log(_consumer_log(spark, sf_dir), path)
    return read_log(spark, path).drop(*OTHER_FIELDS)


@query
def route_sink(spark, sf_dir):
    """Outcome of one delivery of every message, read back from the three routes."""
    src, out = scratch(spark, "envelopes"), scratch(spark, "routed")
    t.envelopes(spark, sf_dir).select(*ENVELOPE.names).write.parquet(src)
    drained(consume(spark, src, out, _fails_on_odd_body))
    return sinks.read_routed(spark, f"{out}/messages").select(
        "message_id",
        "receipt_handle",
        "route",
        F.col("attributes")[messages.RECEIVE_COUNT].alias("receive_count_text"),
        "outcome.success",
        "outcome.error_type",
    )


def _fails_on_odd_body(message):
    """Handler: fails for a body whose number is 90 or more."""
    number = F.regexp_extract(message["body"], r"(\d+)", 1).try_cast("int")
    return outcome(F.coalesce(number, F.lit(0)) < 90, "number too high", "ValueError")


# Row-level operators


@query
def normalize_messages(spark, sf_dir):
    return messages.normalize_messages(t.envelopes(spark, sf_dir)).select(
        "event_id",
        "message_id",
        "receipt_handle",
        "body",
        "receive_count",
        "bad_receive_count",
        "body_length",
    )


def _processed(spark, sf_dir, handler=t.fails_on_error_queue) -> DataFrame:
    return messages.process_messages(messages.normalize_messages(t.envelopes(spark, sf_dir)), handler)


def _outcomes(df: DataFrame) -> DataFrame:
    return df.select("event_id", "message_id", "outcome.success", "outcome.error", "outcome.error_type")


@query
def process_messages(spark, sf_dir):
    return _outcomes(_processed(spark, sf_dir))


@query
def process_messages_python(spark, sf_dir):
    return _outcomes(_processed(spark, sf_dir, python_handler(t.fails_on_error_queue_python, ["queue"])))


@query
def route_outcomes(spark, sf_dir):
    """Every receive of the receive log with its outcome, routed."""
    received = t.receives_with_outcome(spark, sf_dir)
    handled = messages.process_messages(received, lambda m: outcome(m["success"], "failed", "RuntimeError"))
    return messages.route_outcomes(handled).select("queue", "message_id", "receive_count", "route")


@query
def log_threshold(spark, sf_dir):
    return logs.log_threshold(t.log_records(spark, sf_dir), "warning").select(
        "asctime", "levelname", "message", "message_id"
    )


@query
def log_query(spark, sf_dir):
    return logs.log_query(t.log_records(spark, sf_dir))


@query
def log_query_latest(spark, sf_dir):
    return logs.log_query(t.log_records(spark, sf_dir), limit=100)


def _consumer_log(spark, sf_dir) -> DataFrame:
    return logs.message_log(_processed(spark, sf_dir), F.col("ts"), t.work_duration())


@query
def message_log(spark, sf_dir):
    return _consumer_log(spark, sf_dir).drop(*OTHER_FIELDS)


@query
def poll_log(spark, sf_dir):
    found = logs.poll_log(polls.empty_poll_streak(t.polls(spark, sf_dir)))
    return found.select("asctime", "name", "levelname", "message", "empty_poll_count")


@query
def constraint_check(spark, sf_dir):
    customers = t.table(spark, sf_dir, "customer").withColumn("name_parts", F.split("c_name", "#"))
    checked = rules.check_rows(
        customers,
        [
            rules.required("c_name"),
            rules.not_placeholder("c_name"),
            rules.max_length("c_name", 20),
            rules.matches("c_name", "^Customer#[0-9]+$"),
            rules.one_of("c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"]),
            rules.in_range("c_acctbal", 0, 9000),
            rules.array_size("name_parts", 2),
        ],
    )
    return checked.select("c_custkey", F.array_join("violations", ",").alias("violations"), "is_valid")


@query
def address_ranges(spark, sf_dir):
    """Blocks of customers: whether they are valid, and how many allowed ranges they overlap and lie within."""
    checked = rules.check_rows(t.address_blocks(spark, sf_dir).repartition("c_custkey"), [addresses.valid_block("block")])
    found = checked.withColumn("range", addresses.address_range(F.col("block"))).select("c_custkey", "block", "is_valid", "range.low", "range.high")
    found = stored(found, "blocks")
    counts = addresses.overlap_counts(found.filter("is_valid"), t.allowed_ranges(spark, sf_dir), "s_suppkey")
    counts = counts.withColumnRenamed("first", "first_range").withColumn("is_valid", F.lit(True))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("overlapping", "containing")}
    side = F.broadcast(counts) if is_small(counts, addresses.BROADCAST_ROWS) else counts
    same = ["is_valid", "low", "high"]
    return found.join(side, same, "left").select("c_custkey", "block", "is_valid", "overlapping", "containing", "first_range").withColumns(zero)


@query
def log_store_query(spark, sf_dir):
    """The log query for one week, out of a store by day and level."""
    path = scratch(spark, "log-store")
    log_store.append_log(t.log_records(spark, sf_dir), path)
    return logs.log_query(log_store.read_log_store(spark, path, ["ERROR"], *LOG_WEEK))


@query
def parse_body(spark, sf_dir):
    """Generated bodies, and as many event bodies that are none."""
    generated = _generated(spark, sf_dir).select("body")
    others = t.sends(spark, sf_dir).select("body")
    return messages.parse_body(generated.unionByName(others))


@query
def body_size(spark, sf_dir):
    return messages.body_size(t.table(spark, sf_dir, "documents"), "text", DOCUMENT_LIMIT).select(
        "doc_id", "n_characters", "n_bytes", "too_large"
    )


@query
def processing_duration(spark, sf_dir):
    timed = t.processing_times(t.table(spark, sf_dir, "events"))
    return messages.processing_duration(timed, "started_at", "finished_at").select("event_id", "duration_ms")


# Joins


def _ack_joined(spark, sf_dir) -> DataFrame:
    return lifecycle.ack_join(t.receives(spark, sf_dir), t.acks(spark, sf_dir))


@query
def ack_join(spark, sf_dir):
    return _ack_joined(spark, sf_dir)


@query
def pending_messages(spark, sf_dir):
    acked = lifecycle.valid_acks(_ack_joined(spark, sf_dir))
    return lifecycle.pending_messages(t.sends(spark, sf_dir), acked)


def _with_policy(spark, sf_dir, grid=None) -> DataFrame:
    """Depth with the policy of its environment; two queues belong to ``dev``."""
    env = F.when(F.col("queue").isin("click", "view"), "dev").otherwise("prod")
    series = _depth(spark, sf_dir, grid=grid).withColumn("env", env)
    return scaling.with_policy(series, scaling.resolve_policy(*t.policies(spark)))


@query
def policy_join(spark, sf_dir):
    joined = _with_policy(spark, sf_dir)
    wanted = desired_replicas(
        F.col("depth"), F.col("queue_length"), F.col("min_replicas"), F.col("max_replicas")
    )
    return joined.withColumn("desired", wanted)


# Aggregations


def _states(spark, sf_dir, as_of=t.AS_OF) -> DataFrame:
    return lifecycle.message_state(
        t.sends(spark, sf_dir), t.receives(spark, sf_dir), t.acks(spark, sf_dir), as_of, t.VISIBILITY_S
    )


@query
def queue_depth(spark, sf_dir):
    return lifecycle.queue_depth(_states(spark, sf_dir))


@query
def send_summary(spark, sf_dir):
    return sending.send_summary(t.send_results(spark, sf_dir))


@query
def send_prediction(spark, sf_dir):
    return sending.predict_replicas(t.send_results(spark, sf_dir))


@query
def outcome_summary(spark, sf_dir):
    return sending.outcome_summary(_processed(spark, sf_dir).withColumn("duration_ms", t.work_duration()))


@query
def retry_profile(spark, sf_dir):
    return lifecycle.retry_profile(t.receives(spark, sf_dir))


def _dead(spark, sf_dir) -> DataFrame:
    return lifecycle.dead_letters(t.receives(spark, sf_dir), t.acks(spark, sf_dir), t.VISIBILITY_S)


@query
def dead_letters(spark, sf_dir):
    return _dead(spark, sf_dir)


def _gauge(spark, sf_dir) -> DataFrame:
    gauge = depth.dead_letter_gauge(
        _dead(spark, sf_dir), t.TICK_S, *t.grid(spark, sf_dir), t.DEAD_LETTERS_KEPT_S
    )
    return gauge.select(
        dead_letter_name(F.col("queue")).alias("queue"),
        tick_time(F.col("tick"), t.TICK_S).alias("ts"),
        "visible",
    )


@query
def dead_letter_alarm(spark, sf_dir):
    return alarm.dlq_alarm(_gauge(spark, sf_dir), t.ALARM_PERIOD)


@query
def poll_profile(spark, sf_dir):
    return polls.poll_profile(t.polls(spark, sf_dir))


# Windows


@query
def attempt_number(spark, sf_dir):
    return lifecycle.attempt_number(t.receives(spark, sf_dir).drop("receive_count"))


@query
def message_state(spark, sf_dir):
    return _states(spark, sf_dir)


def _depth(spark, sf_dir, include_in_flight=False, grid=None) -> DataFrame:
    return depth.depth_series(
        t.sends(spark, sf_dir),
        t.receives(spark, sf_dir),
        t.acks(spark, sf_dir),
        t.TICK_S,
        *(grid or t.grid(spark, sf_dir)),
        t.VISIBILITY_S,
        include_in_flight=include_in_flight,
    )


@query
def depth_series(spark, sf_dir):
    return _depth(spark, sf_dir)


@query
def depth_series_in_flight(spark, sf_dir):
    return _depth(spark, sf_dir, include_in_flight=True)


@query
def empty_poll_streak(spark, sf_dir):
    return polls.empty_poll_streak(t.polls(spark, sf_dir))


def _recommended(spark, sf_dir) -> DataFrame:
    base = scaling.Policy()
    policy = base._replace(
        cooldown_s=base.cooldown_s * t.SCALE, stabilization_s=base.stabilization_s * t.SCALE
    )
    first, last = t.grid(spark, sf_dir)
    long = ROWS_PER_TASK if last - first >= ROWS_PER_TASK else None  # else no queue has so many ticks
    return scaling.recommend_replicas(_depth(spark, sf_dir, grid=(first, last)), policy, t.TICK_S, rows_per_task=long)


@query
def replica_recommendation(spark, sf_dir):
    return _recommended(spark, sf_dir)


@query
def replica_rate_limits(spark, sf_dir):
    """One worker more per tick at most, and no more than half of them less within two ticks."""
    return limits.limit_changes(
        _recommended(spark, sf_dir),
        t.TICK_S,
        up=[limits.RateLimit("pods", 1, 15 * t.SCALE)],
        down=[limits.RateLimit("percent", 50, 30 * t.SCALE)],
    )


@query
def replica_recommendation_by_env(spark, sf_dir):
    """As above, by the policy of each queue's environment, durations scaled."""
    scaled = {c: F.col(c) * t.SCALE for c in ("cooldown_s", "stabilization_s")}
    first, last = t.grid(spark, sf_dir)
    joined = _with_policy(spark, sf_dir, grid=(first, last)).withColumns(scaled)
    long = ROWS_PER_TASK if last - first >= ROWS_PER_TASK else None
    return scaling.recommend_replicas(joined, None, t.TICK_S, scaling.Policy().stabilization_s * t.SCALE, long)


@query
def change_detection(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    found = retention.detect_changes(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]
    )
    return found.select("o_orderkey", "o_custkey", "fingerprint", "changed")


# Batches and retention


@query
def batch_assignment(spark, sf_dir):
    sent = t.sends(spark, sf_dir).drop("body")
    return sending.assign_batches(sent, generator.BATCH_SIZE, ["queue"], ["sent_at", "message_id"])


@query
def retain_latest(spark, sf_dir):
    return retention.retain_latest(t.versions(spark, sf_dir))


#: Rules that overlap: the one in the middle looks at rows the first has claimed, and the last at any row.
RETENTION_RULES = [
    retention.RetentionRule(1, "count", 500, ("v",)),
    retention.RetentionRule(2, "count", 300, ("v", "sha-")),
    retention.RetentionRule(3, "age", 200 * 86_400),
]


@query
def retention_rules(spark, sf_dir):
    return retention.apply_rules(t.versions(spark, sf_dir), RETENTION_RULES, UNTAGGED_AS_OF)


@query
def expire_messages(spark, sf_dir):
    return retention.expire_by_age(
        t.sends(spark, sf_dir).drop("body"), "sent_at", retention.MESSAGE_RETENTION, t.AS_OF
    )


@query
def expire_dead_letters(spark, sf_dir):
    dead = _dead(spark, sf_dir).select("queue", "message_id", "dead_at")
    return retention.expire_by_age(dead, "dead_at", retention.DEAD_LETTER_RETENTION, t.AS_OF)


@query
def expire_untagged(spark, sf_dir):
    return retention.expire_by_age(
        t.versions(spark, sf_dir),
        "pushed_at",
        retention.UNTAGGED_RETENTION,
        UNTAGGED_AS_OF,
        F.col("tag").isNull(),
    )


# Scalar functions


@query
def replica_formula(spark, sf_dir):
    """The formula on the number of orders of every customer."""
    return (
        t.table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("depth"))
        .withColumn("replicas", desired_replicas(F.col("depth")))
    )


@query
def queue_names(spark, sf_dir):
    """Names for every customer; half of them come without a name of their own."""
    own = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.lit("  "))
    name = queue_name(own, F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return t.table(spark, sf_dir, "customer").select(
        "c_custkey", name.alias("queue"), dead_letter_name(name).alias("dead_letter_queue")
    )


# Streaming


@query
def bounded_polls(spark, sf_dir):
    """Every message by polls of ten, a hundred by each consumer in a micro-batch; ``bounded`` tells that its poll held no more."""
    src, out = _stored_envelopes(spark, sf_dir), scratch(spark, "polled")
    stream = stream_polls(spark, src, MOST_PER_POLL, consumers=1_000, rounds=100)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    polled = read_messages(spark, out, schema=POLLED)
    sizes = polled.groupBy("poll").agg(F.count("*").alias("size"))
    return _text_columns(polled.join(sizes, "poll"), (F.col("size") <= MOST_PER_POLL).alias("bounded"))


def _deletes_most(message):
    """Deleter: fails for every seventh message at its first delivery, and always for every 63rd."""
    number = F.coalesce(F.regexp_extract(message["receipt_handle"], r"(\d+)", 1).try_cast("int"), F.lit(0))
    fails = (number % 7 == 3) & ((message["receive_count"] == 1) | (number % 9 == 0))
    return messages.deletion(~fails, "receipt handle has expired", "ReceiptHandleIsInvalid")


@query
def failed_deletes(spark, sf_dir):
    """Deliver every message until it is deleted or dead; some cannot be deleted at once."""
    src, out = _stored_envelopes(spark, sf_dir), scratch(spark, "consumer")
    return consume_rounds(spark, src, out, _fails_on_odd_body, deleter=_deletes_most).select(
        "message_id", "receipt_handle", "receive_count", "route", "outcome.success"
    )


@query
def consumer_rounds(spark, sf_dir):
    """Deliver every message until it is acknowledged or dead."""
    src, out = _stored_envelopes(spark, sf_dir), scratch(spark, "consumer")
    return consume_rounds(spark, src, out, _fails_on_odd_body).select(
        "message_id", "receipt_handle", "receive_count", "route"
    )


def _fed_in_order(spark, df: DataFrame, ts: str, start) -> None:
    """Run the query that ``start`` gives for a stream over ``df`` in three goes, each over a later stretch of time.

    ``df`` is worked out once and stored by time; the stretches are appended from there,
    each by as many tasks as hold its rows. A stretch is one micro-batch however many files
    it has: its files are not in order of time among each other.
    """
    staged = stored(df.repartitionByRange(ts), "staged")
    path = scratch(spark, "stream")
    first, last = staged.agg(F.min(ts), F.max(ts)).first()  # from the files' statistics
    third = (last - first) / 3 if first is not None else None
    edges = [first + k * third for k in (1, 2)] if first is not None else []
    at = F.col(ts)
    stretches = [at < edges[0], (at >= edges[0]) & (at < edges[1]), at >= edges[1]] if edges else [F.lit(True)]
    for stretch in stretches:
        staged.filter(stretch).write.mode("append").parquet(path)
        drained(start(stream_messages(spark, path, None, schema=df.schema)))


@query
def stateful_retry(spark, sf_dir):
    out = scratch(spark, "retries")
    _fed_in_order(spark, t.receives_with_outcome(spark, sf_dir), "received_at", lambda s: retry_state(s, out))
    return read_decisions(spark, out).drop("received_at")


@query
def stateful_retry_any_order(spark, sf_dir):
    """The same decisions from micro-batches that come in another order than the receives: by hash, in four goes."""
    path, out = scratch(spark, "stream"), scratch(spark, "retries")
    staged = stored(t.receives_with_outcome(spark, sf_dir), "staged")
    for go in range(4):
        part = staged.filter(F.pmod(F.xxhash64("receipt_handle"), F.lit(4)) == go)
        part.write.mode("append").parquet(path)
        drained(retry_in_any_order(stream_messages(spark, path, None, schema=staged.schema), out))
    return latest_decisions(spark, out).drop("received_at")


@query
def dead_letter_alarm_stream(spark, sf_dir):
    out = scratch(spark, "alarms")
    _fed_in_order(
        spark, _gauge(spark, sf_dir), "ts", lambda s: dlq_alarm_stream(s, out, t.ALARM_PERIOD, lateness=LATENESS)
    )
    return read_alarms(spark, out)


@query
def redelivery_dedup(spark, sf_dir):
    out = scratch(spark, "deduplicated")
    _fed_in_order(
        spark, t.receives_with_outcome(spark, sf_dir), "received_at", lambda s: dedup_messages(s, out, DELAY_S)
    )
    return first_deliveries(spark, out, DELAY_S)
