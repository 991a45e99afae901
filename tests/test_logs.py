"""Structured log: levels, query, records of a consumer, sink and source."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from queuelens.functions.handlers import outcome
from queuelens.operators import logs
from queuelens.operators.messages import RECEIVE_COUNT, normalize_messages, process_messages
from queuelens.operators.polls import empty_poll_streak
from queuelens.schemas import ENVELOPE, LOG_RECORD, POLL_LOG
from queuelens.session import scratch
from queuelens.sources.messages import read_log
from queuelens.sources.sinks import write_log

LEVELS = ["DEBUG", "info", "Warning", "ERROR", "CRITICAL", "odd", None]


@pytest.mark.parametrize(
    "threshold, kept",
    [
        ("NOTSET", LEVELS),
        ("debug", LEVELS),
        ("INFO", LEVELS[1:]),
        ("unheard-of", LEVELS[1:]),
        ("warning", LEVELS[2:5]),
        ("Error", LEVELS[3:5]),
        ("CRITICAL", LEVELS[4:5]),
    ],
)
def test_threshold(spark, threshold, kept):
    df = spark.createDataFrame([(level,) for level in LEVELS], "levelname string")
    assert [row[0] for row in logs.log_threshold(df, threshold).collect()] == kept


@pytest.fixture(scope="module")
def records(spark):
    rows = [("1", "r1", 'say "hi"', {}), ("2", "r2", "bad", {RECEIVE_COUNT: "2"})]
    df = normalize_messages(spark.createDataFrame(rows, ENVELOPE))
    df = process_messages(df, lambda m: outcome(m["body"] != "bad", "boom", "RuntimeError"))
    return logs.message_log(df, F.lit("2024-01-01 10:00:00.25").cast("timestamp_ntz"), F.lit(12.5))


def test_records_of_a_consumer(records):
    got = [
        {k: v for k, v in row.asDict().items() if v is not None and k not in ("asctime", "name")}
        for row in records.orderBy("message_id").collect()
    ]
    assert got == [
        {"levelname": "INFO", "message": "Processing message", "message_id": "1", "receive_count": 1, "body_length": 8},
        {"levelname": "INFO", "message": 'Received message: say "hi"', "message_id": "1", "body": 'say "hi"'},
        {"levelname": "INFO", "message": "Message processed successfully", "message_id": "1", "duration_ms": 12.5},
        {"levelname": "DEBUG", "message": "Message deleted from queue", "message_id": "1"},
        {"levelname": "INFO", "message": "Processing message", "message_id": "2", "receive_count": 2, "body_length": 3},
        {"levelname": "INFO", "message": "Received message: bad", "message_id": "2", "body": "bad"},
        {
            "levelname": "ERROR",
            "message": "Message processing failed",
            "message_id": "2",
            "receive_count": 2,
            "duration_ms": 12.5,
            "error": "boom",
            "error_type": "RuntimeError",
        },
        {
            "levelname": "WARNING",
            "message": "Message not deleted — will retry or go to DLQ",
            "message_id": "2",
        },
    ]


def test_sink_and_source(spark, records):
    path = scratch(spark, "test-log")
    write_log(records, path)
    lines = [json.loads(row[0]) for row in spark.read.text(path).collect()]
    assert len(lines) == 8
    assert all(list(line)[:4] == ["asctime", "name", "levelname", "message"] for line in lines)
    assert all(None not in line.values() and line["asctime"] == "2024-01-01T10:00:00" for line in lines)
    back = read_log(spark, path)
    assert back.schema == LOG_RECORD
    second = records.withColumn("asctime", F.date_trunc("second", "asctime").cast("timestamp_ntz"))
    assert sorted(map(str, back.collect())) == sorted(map(str, second.collect()))
    assert [row["message_id"] for row in logs.log_query(back).collect()] == ["2"]


def test_query_is_newest_first(spark):
    rows = [(datetime(2024, 1, d), "ERROR" if d != 3 else "INFO", "m", str(i), None) for i, d in enumerate([2, 5, 3, 5, 1])]
    df = spark.createDataFrame(
        rows, "asctime timestamp_ntz, levelname string, message string, message_id string, duration_ms double"
    )
    assert [row["message_id"] for row in logs.log_query(df).collect()] == ["1", "3", "0", "4"]
    assert [row["message_id"] for row in logs.log_query(df, limit=2).collect()] == ["1", "3"]
    assert [row["message_id"] for row in logs.log_query(df, "INFO").collect()] == ["2"]


def test_poll_log(spark):
    rows = [(1, datetime(2024, 1, 1), "empty", 0), (1, datetime(2024, 1, 2), "api_error", 0), (1, datetime(2024, 1, 3), "got", 1)]
    streaks = empty_poll_streak(spark.createDataFrame(rows, POLL_LOG)).withColumn("error_code", F.lit("Throttled"))
    got = [{k: v for k, v in row.asDict().items() if v is not None} for row in logs.poll_log(streaks).collect()]
    assert got == [
        {
            "asctime": datetime(2024, 1, 1),
            "name": "queue",
            "levelname": "DEBUG",
            "message": "No messages received (queue may be empty)",
            "empty_poll_count": 1,
        },
        {
            "asctime": datetime(2024, 1, 2),
            "name": "queue",
            "levelname": "ERROR",
            "message": "SQS API error during receive",
            "error_code": "Throttled",
        },
    ]


def test_delete_failure_and_unexpected_errors_are_logged(spark):
    rows = [("a", True, "denied", "AccessDenied"), ("b", True, None, None), ("c", False, None, None)]
    df = spark.createDataFrame(rows, "message_id string, ok boolean, delete_error string, delete_error_code string")
    df = df.withColumns({"body": F.lit("x"), "receive_count": F.lit(1), "body_length": F.lit(1)})
    df = df.withColumn("outcome", outcome(F.col("ok"), "boom", "RuntimeError"))
    got = logs.message_log(df, F.lit("2024-01-01 00:00:00"), F.lit(1.0)).filter(F.col("message").contains("elete"))
    assert {(r["message_id"], r["levelname"], r["message"], r["error"], r["error_code"]) for r in got.collect()} == {
        ("a", "ERROR", "Failed to delete message — it will reappear after VisibilityTimeout", "denied", "AccessDenied"),
        ("b", "DEBUG", "Message deleted from queue", None, None),
        ("c", "WARNING", "Message not deleted — will retry or go to DLQ", None, None),
    }
    polls = spark.createDataFrame(
        [("unexpected", 0, "broken", "OSError", "Traceback ..."), ("empty", 2, None, None, None)],
        "kind string, streak bigint, error string, error_type string, exc_info string",
    ).withColumn("polled_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = {(r["levelname"], r["message"], r["error_type"], r["exc_info"]) for r in logs.poll_log(polls).collect()}
    assert got == {
        ("ERROR", "Unexpected error in polling loop", "OSError", "Traceback ..."),
        ("DEBUG", "No messages received (queue may be empty)", None, None),
    }
