"""Streams: drained result equals the batch answer, restarts add nothing."""

import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuelens.functions.handlers import accept_all, outcome, python_handler
from queuelens.operators.alarm import dlq_alarm
from queuelens.operators.messages import RECEIVE_COUNT, normalize_messages, process_messages, route_outcomes
from queuelens.schemas import ENVELOPE, GAUGE, RECEIVE_LOG
from queuelens.session import is_small, scratch, shared_dir
from queuelens.sources.messages import read_messages, stream_messages
from queuelens.sources.sinks import read_routed, route_sink
from queuelens.streaming.alarm import dlq_alarm_stream, read_alarms
from queuelens.streaming.consume import consume, consume_rounds
from queuelens.streaming.dedup import dedup_messages, first_deliveries
from queuelens.streaming.retry import read_decisions, retry_state
from queuelens.streaming.running import drained

DAY = datetime(2024, 1, 1)


def poison_fails(message):
    return outcome(~F.contains(message["body"], F.lit("poison")), "boom", "RuntimeError")


def put(spark, path, bodies, first=0):
    rows = [(f"m{first + i}", f"r{first + i}", body, {RECEIVE_COUNT: "1"}) for i, body in enumerate(bodies)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(path)


def routes(df):
    return Counter((row["message_id"], row["receive_count"], row["route"]) for row in df.collect())


def test_empty_queue(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    spark.createDataFrame([], ENVELOPE).write.parquet(src)
    assert read_messages(spark, src).count() == 0
    assert consume_rounds(spark, src, sink, accept_all).count() == 0


def test_whole_life_of_a_queue(spark):
    """Empty, ten messages, all processed, empty again; new messages later."""
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    spark.createDataFrame([], ENVELOPE).write.parquet(src)
    drained(consume(spark, src, sink, accept_all))
    put(spark, src, [f"test-message-{i + 1}" for i in range(10)])
    drained(consume(spark, src, sink, accept_all))
    done = read_routed(spark, f"{sink}/messages")
    assert routes(done) == Counter({(f"m{i}", 1, "ack"): 1 for i in range(10)})
    drained(consume(spark, src, sink, accept_all))
    assert read_routed(spark, f"{sink}/messages").count() == 10
    put(spark, src, ["late"], first=10)
    drained(consume(spark, src, sink, accept_all))
    assert read_routed(spark, f"{sink}/messages").count() == 11


def test_one_file_per_poll(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    for i in range(3):
        put(spark, src, [f"message-{i}"], first=i)
    query = drained(consume(spark, src, sink, accept_all, max_per_trigger=1))
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1, 1, 1]
    with pytest.raises(ValueError):
        stream_messages(spark, src, 0)


@pytest.mark.parametrize("native", [True, False])
def test_poison_message_ends_as_dead_letter(spark, native):
    def handle(message):
        if "poison" in message["body"]:
            raise RuntimeError("boom")

    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    put(spark, src, ["fine", "poison", "fine"])
    put(spark, src, ["poison 2"], first=3)
    handler = poison_fails if native else python_handler(handle)
    got = consume_rounds(spark, src, sink, handler)
    assert routes(got) == Counter(
        {("m0", 1, "ack"): 1, ("m1", 3, "dead"): 1, ("m2", 1, "ack"): 1, ("m3", 3, "dead"): 1}
    )
    dead = got.filter("route = 'dead'").first()
    assert tuple(dead["outcome"])[:3] == (False, "boom", "RuntimeError")
    # A second call finds nothing new; a new message goes through all rounds.
    assert routes(consume_rounds(spark, src, sink, handler)) == routes(got)
    put(spark, src, ["more poison"], first=9)
    assert consume_rounds(spark, src, sink, handler).count() == 5


def test_odd_receive_counts_end_too(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    counts = ["0", "-1", "2", "3", "7", "x", None]
    rows = [(f"m{i}", "r", "poison", {RECEIVE_COUNT: n}) for i, n in enumerate(counts)]
    spark.createDataFrame(rows, ENVELOPE).write.parquet(src)
    got = consume_rounds(spark, src, sink, poison_fails)
    assert routes(got) == Counter({(f"m{i}", 7 if n == "7" else 3, "dead"): 1 for i, n in enumerate(counts)})


def test_messages_without_id_stay_apart(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    spark.createDataFrame([(None, None, body, None) for body in ["fine", "fine", "poison"]], ENVELOPE).write.parquet(src)
    got = consume_rounds(spark, src, sink, poison_fails)
    assert routes(got) == Counter({("unknown", 1, "ack"): 2, ("unknown", 3, "dead"): 1})


def test_replayed_batch_replaces_itself(spark):
    path = scratch(spark, "sink")
    rows = [(f"m{i}", f"r{i}", "poison" if i < 4 else "fine", {"Other": "1"}) for i in range(8)]
    received = normalize_messages(spark.createDataFrame(rows, ENVELOPE))
    write = route_sink(path)
    write(route_outcomes(process_messages(received, poison_fails)), 0)
    write(route_outcomes(process_messages(received, accept_all)), 1)
    assert Counter(r["route"] for r in read_routed(spark, path).collect()) == {"retry": 4, "ack": 12}
    again = read_routed(spark, path).filter("route = 'retry'").first()
    assert again["attributes"] == {"Other": "1", RECEIVE_COUNT: "2"}
    # The same batch again, this time all succeed: its retry rows must be gone.
    write(route_outcomes(process_messages(received, accept_all)), 0)
    assert Counter(r["route"] for r in read_routed(spark, path).collect()) == {"ack": 16}


def test_unbounded_run_picks_up_new_files_until_stopped(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    put(spark, src, ["one"])
    query = consume(spark, src, sink, accept_all, available_now=False)
    try:
        query.processAllAvailable()
        assert query.isActive and read_routed(spark, f"{sink}/messages").count() == 1
    finally:
        query.stop()
    put(spark, src, ["two"], first=1)
    drained(consume(spark, src, sink, accept_all))
    assert read_routed(spark, f"{sink}/messages").count() == 2


def test_slow_handler_drains(spark):
    def slow(message):
        time.sleep(1.5)

    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    for i in range(3):
        put(spark, src, [f"message-{i}"], first=i)
    drained(consume(spark, src, sink, python_handler(slow), max_per_trigger=1), 30)
    assert read_routed(spark, f"{sink}/messages").count() == 3


def test_endless_query_is_stopped_and_reported(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    put(spark, src, ["one"])
    query = consume(spark, src, sink, accept_all, available_now=False)
    with pytest.raises(TimeoutError):
        drained(query, 3)
    assert not query.isActive


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_formats(spark, fmt):
    path = scratch(spark, fmt)
    rows = [("a", "r", "Grüße 世界 🌍", {RECEIVE_COUNT: "2"}), (None, None, None, None)]
    spark.createDataFrame(rows, ENVELOPE).write.format(fmt).save(path)
    back = read_messages(spark, path, fmt)
    assert back.schema == ENVELOPE
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame(rows, ENVELOPE).collect()))


def receive_rows():
    """Messages with three failures, late success, success at once, and a flood."""
    plan = {1: [0, 0, 0], 2: [0, 0, 1], 3: [1], 4: [0], 5: [0] * 7}
    rows = []
    for m, results in plan.items():
        for k, ok in enumerate(results, 1):
            rows.append(("q", m, k, f"r-{m}-{k}", DAY + timedelta(minutes=10 * k + m), bool(ok)))
    return sorted(rows, key=lambda r: r[4])


@pytest.fixture(scope="module")
def receive_files(spark):
    path = scratch(spark, "receives")
    rows = receive_rows()
    for start in range(0, len(rows), 5):
        df = spark.createDataFrame(rows[start : start + 5], RECEIVE_LOG.simpleString()[7:-1].replace(":", " ") + ", success boolean")
        df.coalesce(1).write.mode("append").parquet(path)
    return path, df.schema


def test_retry_state(spark, receive_files):
    path, schema = receive_files
    out = scratch(spark, "out")
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        drained(retry_state(stream_messages(spark, path, 1, schema=schema), out), 600)
        got = read_decisions(spark, out)
        want = Counter(
            [(1, 1, "retry"), (1, 2, "retry"), (1, 3, "dead"), (2, 1, "retry"), (2, 2, "retry"), (4, 1, "retry")]
            + [(5, k, "dead" if k == 3 else "retry") for k in (1, 2, 3, 1, 2, 3, 1)]
        )
        assert Counter((r["message_id"], r["receive_count"], r["route"]) for r in got.collect()) == want


@pytest.mark.parametrize("files", [1, 4])
def test_retry_does_not_depend_on_micro_batches(spark, receive_files, files):
    """A success starts the count anew, whether or not it comes in the same micro-batch."""
    results = [0, 1, 0, 0]
    rows = [("q", 1, k + 1, f"r{k}", DAY + timedelta(hours=k), bool(ok)) for k, ok in enumerate(results)]
    path, out = scratch(spark, "src"), scratch(spark, "out")
    for part in [rows[::-1]] if files == 1 else [[r] for r in rows]:
        spark.createDataFrame(part, receive_files[1]).coalesce(1).write.mode("append").parquet(path)
    drained(retry_state(stream_messages(spark, path, 1, schema=receive_files[1]), out), 600)
    got = {(r["receipt_handle"], r["receive_count"], r["route"]) for r in read_decisions(spark, out).collect()}
    assert got == {("r0", 1, "retry"), ("r2", 1, "retry"), ("r3", 2, "retry")}


def test_dedup(spark, receive_files):
    path, schema = receive_files
    out = scratch(spark, "out")
    drained(dedup_messages(stream_messages(spark, path, 1, schema=schema), out, 7200), 600)
    got = {r["message_id"]: (r["received_at"], r["receipt_handle"]) for r in first_deliveries(spark, out, 7200).collect()}
    assert got == {m: (DAY + timedelta(minutes=10 + m), f"r-{m}-1") for m in (1, 2, 3, 4, 5)}


def test_dedup_keeps_the_earliest_whatever_the_order(spark, receive_files):
    """The later delivery stands first in the file; one beyond the delay is a delivery of its own."""
    at = [DAY + timedelta(minutes=m) for m in (30, 10, 50, 900)]
    rows = [("q", 1, 1, f"r{k}", t, False) for k, t in enumerate(at)]
    path, out = scratch(spark, "src"), scratch(spark, "out")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, receive_files[1]).coalesce(1).write.mode("append").parquet(path)
    drained(dedup_messages(stream_messages(spark, path, 1, schema=receive_files[1]), out, 3600), 600)
    got = sorted((r["received_at"], r["receipt_handle"]) for r in first_deliveries(spark, out, 3600).collect())
    assert got == [(at[1], "r1"), (at[3], "r3")]


def test_alarm_stream_equals_batch(spark):
    path, out = scratch(spark, "gauge"), scratch(spark, "out")
    samples = [("d", DAY + timedelta(seconds=20 * i), int(i % 7 == 0)) for i in range(60)]
    for start in range(0, 60, 20):
        spark.createDataFrame(samples[start : start + 20], GAUGE).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # nothing changes by a second run
        drained(dlq_alarm_stream(stream_messages(spark, path, 1, schema=GAUGE), out, lateness="120 seconds"), 600)
        batch = dlq_alarm(spark.createDataFrame(samples, GAUGE))
        assert Counter(read_alarms(spark, out).collect()) == Counter(batch.collect())
        assert batch.count() == 20


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert scratch(spark, "x") != scratch(spark, "x")


def test_small_means_at_most_the_bound(spark):
    assert is_small(spark.range(10), 10)
    assert not is_small(spark.range(11), 10)
