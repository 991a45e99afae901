"""Polls of a bounded number of messages, and deletions that fail."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from queuelens.functions.handlers import accept_all, outcome
from queuelens.operators.messages import RECEIVE_COUNT, deletion, normalize_messages, process_messages, route_outcomes
from queuelens.schemas import ENVELOPE
from queuelens.session import scratch
from queuelens.sources.polls import PollReader, stream_polls
from queuelens.sources.sinks import delete_acknowledged, delete_sink, read_deletions, read_settled
from queuelens.streaming.consume import consume_rounds


def put(spark, path, first, n):
    rows = [(f"m{i}", f"r{i}", f"body {i}", {RECEIVE_COUNT: "1"} if i % 3 else None) for i in range(first, first + n)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(path)


def ran(stream, out, checkpoint):
    batches = []

    def write(batch, batch_id):
        batches.append(batch.count())
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [n for n in batches if n]


@pytest.mark.parametrize("n, consumers, want", [(1, 4, [4, 4, 3]), (4, 1, [4, 3, 4]), (10, 2, [11])])
def test_polls_are_bounded_and_lose_nothing(spark, n, consumers, want):
    src, out, checkpoint = (scratch(spark, x) for x in ("src", "out", "checkpoint"))
    put(spark, src, 0, 7)
    put(spark, src, 7, 4)
    assert ran(stream_polls(spark, src, n, consumers), out, checkpoint) == want
    rows = spark.read.parquet(out)
    assert Counter(r["message_id"] for r in rows.collect()) == Counter(f"m{i}" for i in range(11))
    polls = rows.groupBy("poll").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    assert all(r["n"] <= n and r["low"] == 0 and r["high"] == r["n"] - 1 for r in polls.collect())
    assert rows.filter("message_id = 'm4'").first()["attributes"] == {RECEIVE_COUNT: "1"}
    # A restart adds nothing; new messages go on where it stood.
    assert ran(stream_polls(spark, src, n, consumers), out, checkpoint) == []
    put(spark, src, 11, 3)
    ran(stream_polls(spark, src, n, consumers), out, checkpoint)
    assert Counter(r["message_id"] for r in spark.read.parquet(out).collect()) == Counter(f"m{i}" for i in range(14))


def test_a_micro_batch_that_was_not_committed_replays_exactly(spark):
    src, out, checkpoint = (scratch(spark, x) for x in ("src", "out", "checkpoint"))
    put(spark, src, 0, 9)
    seen = {}

    def start(fail_at):
        def write(batch, batch_id):
            rows = sorted((r["message_id"], r["poll"]) for r in batch.collect())
            assert seen.setdefault(batch_id, rows) == rows
            if batch_id == fail_at:
                raise RuntimeError("lost")

        query = stream_polls(spark, src, 2, 1).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        start(fail_at=2)
    put(spark, src, 9, 1)
    start(fail_at=None)
    assert Counter(m for rows in seen.values() for m, _ in rows) == Counter(f"m{i}" for i in range(10))
    assert max(map(len, seen.values())) == 2


def test_rounds_make_fewer_micro_batches_of_the_same_polls(spark):
    src = scratch(spark, "src")
    put(spark, src, 0, 23)
    put(spark, src, 23, 9)
    seen = []
    for rounds, want in ((1, [6, 6, 6, 5, 6, 3]), (3, [18, 14]), (50, [32])):
        out = scratch(spark, "out")
        assert ran(stream_polls(spark, src, 3, 2, rounds), out, scratch(spark, "checkpoint")) == want
        seen.append(Counter((r["message_id"], r["poll"].split(":")[1], r["place"]) for r in spark.read.parquet(out).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 32


def test_planning_takes_no_longer_for_more_polls(monkeypatch):
    """A backlog of a thousand million messages is a handful of parts, each told by two numbers."""
    monkeypatch.setattr(PollReader, "_behind", lambda self, start: [(1, "a"), (2, "b")])
    monkeypatch.setattr(PollReader, "_length", lambda self, path: 10**9)
    reader = PollReader({"path": "/nowhere", "messagesperpoll": "10", "consumers": "1000", "rounds": "150000", "tasks": "4"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"time": 2, "file": "b", "row": 5 * 10**8}
    parts = reader.partitions(start, end)
    assert [(p.path, p.first, p.last) for p in parts] == [("a", k, min(k + 375 * 10**6, 10**9)) for k in range(0, 10**9, 375 * 10**6)] + [
        ("b", 0, 375 * 10**6), ("b", 375 * 10**6, 5 * 10**8)
    ]


def test_only_1_to_10_messages(spark):
    for n, consumers in ((0, 1), (11, 1), (3, 0)):
        with pytest.raises(ValueError):
            PollReader({"path": "/nowhere", "messagesperpoll": str(n), "consumers": str(consumers)})
    assert PollReader({"path": "/nowhere"}).latestOffset() == {"time": 0, "file": "", "row": 0}


def clings(message):
    """m0 cannot be deleted at its first delivery, m1 never."""
    fails = (message["message_id"] == "m1") | ((message["message_id"] == "m0") & (message["receive_count"] == 1))
    return deletion(~fails, "receipt handle has expired", "ReceiptHandleIsInvalid")


def fails_on_two(message):
    return outcome(message["message_id"] != "m2", "boom", "RuntimeError")


def test_failed_deletes_come_back(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "sink")
    put(spark, src, 0, 4)
    for _ in range(2):  # a second call finds nothing new
        got = consume_rounds(spark, src, sink, fails_on_two, deleter=clings)
        assert Counter((r["message_id"], r["receive_count"], r["route"], r["outcome"]["success"]) for r in got.collect()) == Counter(
            [("m0", 2, "ack", True), ("m1", 3, "dead", True), ("m2", 3, "dead", False), ("m3", 1, "ack", True)]
        )
    log = read_deletions(spark, f"{sink}/round=1")
    assert {(r["message_id"], r["deletion"]["deleted"], r["deletion"]["error_code"], r["route"]) for r in log.collect()} == {
        ("m0", False, "ReceiptHandleIsInvalid", "retry"), ("m1", False, "ReceiptHandleIsInvalid", "retry"), ("m3", True, None, "ack")
    }
    again = log.filter("message_id = 'm1'").first()
    assert again["attributes"][RECEIVE_COUNT] == "2"


def test_both_steps_replay(spark):
    """The whole micro-batch again, and the second step alone; a deleter that works the second time leaves no trace of the first."""
    path = scratch(spark, "sink")
    rows = [(f"m{i}", f"r{i}", "x", None) for i in range(6)]
    routed = route_outcomes(process_messages(normalize_messages(spark.createDataFrame(rows, ENVELOPE)), accept_all))
    write = delete_sink(path, clings)
    for _ in range(2):
        write(routed, 0)
        assert Counter(r["route"] for r in read_settled(spark, path).collect()) == {"ack": 4, "retry": 2}
    delete_acknowledged(spark, path, 0, lambda m: deletion(F.lit(True), "", ""))
    assert Counter(r["route"] for r in read_settled(spark, path).collect()) == {"ack": 6}
    delete_acknowledged(spark, path, 0, lambda m: deletion(F.lit(None).cast("boolean"), "lost", "Timeout"))
    assert Counter(r["route"] for r in read_settled(spark, path).collect()) == {"retry": 6}


def test_nothing_deleted_yet(spark):
    assert read_deletions(spark, scratch(spark, "none")).collect() == [] == read_settled(spark, scratch(spark, "none")).collect()
