"""Row-level operators on the envelope edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from queuelens.functions.handlers import accept_all, outcome, python_handler
from queuelens.functions.scalars import dead_letter_name, desired_replicas, duration_ms, queue_name
from queuelens.operators import messages as m
from queuelens.operators import rules
from queuelens.schemas import ENVELOPE
from queuelens.sources.generator import generate_messages

COUNT = m.RECEIVE_COUNT


def envelope(spark, *rows):
    return spark.createDataFrame(list(rows), ENVELOPE)


def test_normalize_defaults(spark):
    df = envelope(
        spark,
        ("a", "r-a", "hello world", {COUNT: "2"}),
        (None, None, None, None),
        ("b", "r-b", "", {}),
        ("c", "r-c", "Grüße 世界 🌍", {COUNT: "many"}),
        ("d", "r-d", "x", {COUNT: None}),
    )
    got = m.normalize_messages(df).select(
        "message_id", "receipt_handle", "body", "receive_count", "bad_receive_count", "body_length"
    )
    assert [tuple(row) for row in got.collect()] == [
        ("a", "r-a", "hello world", 2, False, 11),
        ("unknown", "", "", 1, False, 0),
        ("b", "r-b", "", 1, False, 0),
        ("c", "r-c", "Grüße 世界 🌍", 1, True, 10),
        ("d", "r-d", "x", 1, False, 1),
    ]


@pytest.mark.parametrize(
    "body",
    ["hello world", "", json.dumps({"kind": "payment", "parts": [1, 2.5], "note": None}), "Grüße 世界 🌍"],
)
def test_any_body_succeeds(spark, body):
    df = m.normalize_messages(envelope(spark, ("msg-001", "receipt", body, {COUNT: "1"})))
    for handler in (accept_all, python_handler(lambda message: None)):
        row = m.route_outcomes(m.process_messages(df, handler)).first()
        assert row["outcome"].asDict() == {"success": True, "error": None, "error_type": None, "exc_info": None}
        assert row["route"] == "ack" and row["body"] == body


def test_missing_id_succeeds(spark):
    df = m.normalize_messages(envelope(spark, (None, "r123", "test", {})))
    assert m.process_messages(df, accept_all).first()["outcome"]["success"] is True


def test_python_handler_keeps_failures_apart(spark):
    def handle(message):
        if message["body"] == "poison":
            raise RuntimeError("Processing failed")
        if message["receive_count"] > 1:
            raise KeyError("gone")

    rows = [(str(i), "r", "poison" if i % 3 == 0 else "fine", {COUNT: str(1 + i % 2)}) for i in range(60)]
    df = m.process_messages(m.normalize_messages(envelope(spark, *rows)), python_handler(handle))
    for row in df.collect():
        i = int(row["message_id"])
        want = (
            (False, "Processing failed", "RuntimeError") if i % 3 == 0
            else (False, "'gone'", "KeyError") if i % 2
            else (True, None, None)
        )
        assert tuple(row["outcome"])[:3] == want
        assert ("Traceback" in (row["outcome"]["exc_info"] or "")) == (not want[0])


def test_python_handler_gets_exact_values_and_attributes(spark):
    """Whole numbers stay whole next to NULLs, NULL is None, attributes are a dictionary."""

    def handle(message):
        assert message["n"] is None or type(message["n"]) is int, message
        assert (message["n"] is None) == (message["message_id"] == "b")
        assert message["attributes"] == ({"k": "v"} if message["message_id"] == "a" else None)

    rows = [("a", 1, {"k": "v"}), ("b", None, None), ("c", 2**60, None)]
    df = spark.createDataFrame(rows, "message_id string, n bigint, attributes map<string,string>")
    assert [r["outcome"]["error"] for r in m.process_messages(df, python_handler(handle)).collect()] == [None] * 3
    native = m.process_messages(df, lambda x: outcome(x["attributes"]["k"] == "v", "no", "KeyError"))
    assert [r["outcome"]["success"] for r in native.collect()] == [True, False, False]
    narrow = python_handler(lambda message: message["n"] + 1, columns=["n"])
    assert [r["outcome"]["success"] for r in m.process_messages(df, narrow).collect()] == [True, False, True]


def test_routes(spark):
    rows = [(ok, n) for ok in (True, False) for n in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "ok boolean, receive_count int")
    df = df.withColumn("outcome", outcome(F.col("ok"), "boom", "RuntimeError"))
    got = [row["route"] for row in m.route_outcomes(df).collect()]
    assert got == ["ack"] * 4 + ["retry", "retry", "dead", "dead"]


def test_body_size(spark):
    df = spark.createDataFrame([("Grüße 世界 🌍",), (None,), ("x" * 262_145,), ("x" * 262_144,)], "body string")
    got = [tuple(row)[1:] for row in m.body_size(df).collect()]
    assert got == [(10, 19, False), (None, None, None), (262_145, 262_145, True), (262_144, 262_144, False)]


def test_generate_and_parse(spark):
    made = generate_messages(spark, "2024-01-01T00:00:00Z", count=1000)
    assert made.count() == 1000
    assert made.filter("n = 11").first().asDict() == {
        "n": 11,
        "batch": 2,
        "entry_id": "msg-11",
        "body": "demo-message-11 | batch=2 | ts=2024-01-01T00:00:00Z | total=1000",
    }
    parsed = m.parse_body(made.select("body", F.col("n").alias("n0"), F.col("batch").alias("batch0")))
    assert parsed.filter("n = n0 AND batch = batch0 AND total = 1000 AND ts = timestamp_ntz'2024-01-01'").count() == 1000
    assert generate_messages(spark, "x", count=0).count() == 0
    assert [row["batch"] for row in generate_messages(spark, "x", 25).orderBy("n").collect()] == (
        [1] * 10 + [2] * 10 + [3] * 5
    )


@pytest.mark.parametrize(
    "body",
    ["", None, "hello", "demo-message-1 | batch=1", "demo-message-x | batch=1 | ts=t | total=1"],
)
def test_parse_other_text(spark, body):
    row = m.parse_body(spark.createDataFrame([(body,)], "body string")).first()
    assert (row["n"], row["batch"], row["ts"], row["total"]) == (None, None, None, None)


def test_duration_rounds_half_up_on_microseconds(spark):
    times = [(0, 0.0), (4, 0.0), (5, 0.01), (14, 0.01), (15, 0.02), (100_125, 100.13), (99_994, 99.99)]
    for micros, want in times:
        df = spark.range(1).select(
            duration_ms(
                F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                F.timestamp_add("MICROSECOND", F.lit(micros), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
            ).alias("d")
        )
        assert df.first()["d"] == want


def test_replica_table(spark):
    table = [(0, 0), (1, 1), (3, 1), (5, 1), (6, 2), (11, 3), (20, 4), (21, 5), (25, 5), (100, 5), (10**12, 5)]
    df = spark.createDataFrame(table, "depth bigint, want bigint").withColumn("got", desired_replicas(F.col("depth")))
    assert df.filter("got <> want OR got IS NULL").count() == 0
    low = spark.range(1).select(desired_replicas(F.lit(0), 5, 2, 3).alias("low"), desired_replicas(F.lit(99), 5, 2, 3).alias("high"))
    assert tuple(low.first()) == (2, 3)


def test_names(spark):
    df = spark.createDataFrame([("orders",), ("  ",), ("",), (None,)], "name string")
    name = queue_name(F.col("name"), F.lit("shop"), F.lit("dev"))
    got = [tuple(row) for row in df.select(name.alias("q"), dead_letter_name(name).alias("d")).collect()]
    assert got == [("orders", "orders-dlq")] + [("shop-dev-queue", "shop-dev-queue-dlq")] * 3


def test_rules(spark):
    df = spark.createDataFrame(
        [
            ("shop", "dev", 3, [1, 2]),
            ("  ", "test", 11, [1]),
            ("REPLACE_ME", "prod", 1, None),
            (None, None, None, []),
            ("a" * 21, "dev", 10, [1, 2]),
        ],
        "name string, env string, size int, subnets array<int>",
    )
    checks = [
        rules.required("name"),
        rules.not_placeholder("name"),
        rules.max_length("name", 20),
        rules.matches("name", "^[a-z0-9-]+$"),
        rules.one_of("env", ["dev", "staging", "prod"]),
        rules.in_range("size", 1, 10),
        rules.array_size("subnets", 2),
    ]
    got = [(row["violations"], row["is_valid"]) for row in rules.check_rows(df, checks).collect()]
    assert got == [
        ([], True),
        (["name_required", "name_pattern", "env_member", "size_range", "subnets_size"], False),
        (["name_placeholder", "name_pattern", "subnets_size"], False),
        ([rule.name for rule in checks], False),
        (["name_length"], False),
    ]
