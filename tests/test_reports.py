"""Scaling, polls, sending, retention, alarm on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuelens.functions.scalars import fingerprint
from queuelens.operators import alarm, depth, polls, retention, scaling, sending
from queuelens.schemas import GAUGE, POLICY, POLL_LOG, VERSION

DAY = datetime(2024, 1, 1)


def test_recommendation_with_cooldown_and_stabilisation(spark):
    depths = [0, 12, 0, 0, 0, 0, 3, 0, 0, 0]
    df = spark.createDataFrame([("q", i, d) for i, d in enumerate(depths)], "queue string, tick bigint, depth bigint")
    rows = scaling.recommend_replicas(df, scaling.Policy(), 15).orderBy("tick").collect()
    assert [row["desired"] for row in rows] == [0, 3, 0, 0, 0, 0, 1, 0, 0, 0]
    assert [row["stabilized"] for row in rows] == [0, 3, 3, 3, 0, 0, 1, 1, 1, 0]
    assert [row["replicas"] for row in rows] == [0, 3, 3, 3, 0, 0, 1, 1, 1, 0]
    longer = scaling.Policy(cooldown_s=61)
    rows = scaling.recommend_replicas(df, longer, 15).orderBy("tick").collect()
    assert [row["replicas"] for row in rows] == [0, 3, 3, 3, 1, 1, 1, 1, 1, 1]


def test_policy_overlay(spark):
    base = spark.createDataFrame([("dev", *scaling.Policy()), ("prod", *scaling.Policy())], POLICY)
    overlay = spark.createDataFrame([("dev", 0, 3, 10, 15, None, None, None)], POLICY)
    got = {row["env"]: tuple(row)[1:] for row in scaling.resolve_policy(base, overlay).collect()}
    assert got == {"dev": (0, 3, 10, 15, 30, 5, False), "prod": (0, 5, 15, 30, 30, 5, False)}
    series = spark.createDataFrame([("dev", 1), ("prod", 2), ("none", 3)], "env string, depth int")
    joined = scaling.with_policy(series, scaling.resolve_policy(base, overlay)).collect()
    assert {(row["env"], row["max_replicas"]) for row in joined} == {("dev", 3), ("prod", 5), ("none", None)}


@pytest.mark.parametrize("rows_per_task", [10**9, 2])
def test_empty_poll_streak(spark, rows_per_task):
    kinds = ["empty", "empty", "api_error", "empty", "got", "empty", "api_error", "got", "got", "empty"]
    want = [1, 2, 2, 3, 0, 1, 1, 0, 0, 1]
    rows = [(c, DAY + timedelta(seconds=i), k, 2 if k == "got" else 0) for c in (1, 2) for i, k in enumerate(kinds)]
    got = polls.empty_poll_streak(spark.createDataFrame(rows, POLL_LOG), rows_per_task)
    for consumer in (1, 2):
        streaks = [r["streak"] for r in got.filter(F.col("consumer") == consumer).orderBy("polled_at").collect()]
        assert streaks == want


def test_poll_profile(spark):
    rows = [
        (1, DAY, "empty", 0),
        (1, DAY + timedelta(minutes=59), "got", 7),
        (1, DAY + timedelta(minutes=60), "api_error", 0),
        (2, DAY, "got", 1),
    ]
    got = polls.poll_profile(spark.createDataFrame(rows, POLL_LOG)).orderBy("consumer", "hour").collect()
    assert [tuple(row) for row in got] == [
        (DAY, 1, 2, 1, 0, 7),
        (DAY + timedelta(hours=1), 1, 1, 0, 1, 0),
        (DAY, 2, 1, 0, 0, 1),
    ]


def test_send_summary(spark):
    rows = [(1, "a", "sent"), (1, "b", "failed"), (2, "c", "sent"), (2, "d", "sent"), (None, "e", "failed")]
    df = spark.createDataFrame(rows, "batch bigint, entry_id string, status string")
    got = {tuple(row) for row in sending.send_summary(df).collect()}
    assert got == {(1, 1, 1, 1, False), (2, 2, 0, 1, False), (None, 0, 1, 1, False), (None, 3, 2, 3, True)}


def test_outcome_summary_is_exact(spark):
    rows = [("q", True, 0.1), ("q", True, 0.2), ("q", False, 0.3), ("p", False, None)]
    df = spark.createDataFrame(rows, "queue string, ok boolean, duration_ms double").withColumn(
        "outcome", F.struct(F.col("ok").alias("success"))
    )
    got = {tuple(row) for row in sending.outcome_summary(df).collect()}
    assert got == {("q", 2, 1, 0.2, 0.3), ("p", 0, 1, None, None)}


def test_fingerprints_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("<null>", "x"), ("null", "x"), ('"', ""), ("", '"')]
    df = spark.createDataFrame(rows, "p string, q string").select(fingerprint("p", "q").alias("f"))
    assert len({row["f"] for row in df.collect()}) == len(rows)


def test_retain_latest_beyond_the_task_limit(spark):
    """More than 1,000 to keep: the same rows as counting by hand, with one key in many tasks."""
    rows = [("r", i, DAY + timedelta(minutes=i), "v") for i in range(1_500)] + [("s", i, DAY, "v") for i in range(3)]
    got = retention.retain_latest(spark.createDataFrame(rows, VERSION), n=1_200, rows_per_task=200)
    assert {(r["repo"], r["id"]) for r in got.filter("expire").collect()} == {("r", i) for i in range(300)}


@pytest.mark.parametrize("rows_per_task", [10**9, 100])
def test_batches_of_one_large_queue(spark, rows_per_task):
    df = spark.range(2500).select(
        F.when(F.col("id") % 5 < 2, "big").otherwise(F.concat(F.lit("q"), F.col("id") % 50)).alias("queue"),
        (F.col("id") % 100).alias("at"),
        "id",
    )
    got = sending.assign_batches(df, 10, ["queue"], ["at", "id"], rows_per_task).collect()
    assert len(got) == 2500
    queues = {}
    for row in sorted(got, key=lambda r: (r["at"], r["id"])):
        queues.setdefault(row["queue"], []).append(row["batch"])
    for batches in queues.values():
        assert batches == [i // 10 + 1 for i in range(len(batches))]


@pytest.mark.parametrize("rows_per_task", [10**9, 3])
def test_retain_latest(spark, rows_per_task):
    rows = [("r", i, DAY + timedelta(days=i // 2), tag) for i, tag in enumerate(["v1", "tmp", None, "sha-1", "latest", "v2", "x"])]
    rows += [("s", 1, DAY, "v1")]
    got = retention.retain_latest(
        spark.createDataFrame(rows, VERSION), n=2, rows_per_task=rows_per_task
    ).orderBy("repo", "id").collect()
    assert [(row["id"], row["expire"]) for row in got] == [
        (0, True), (1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (1, False),
    ]


def test_expire_by_age(spark):
    rows = [("r", i, DAY + timedelta(seconds=i), None if i else "v") for i in range(4)] + [("r", 9, None, None)]
    df = spark.createDataFrame(rows, VERSION)
    as_of = str(DAY + timedelta(seconds=12))
    got = [row["expire"] for row in retention.expire_by_age(df, "pushed_at", 10, as_of).orderBy("id").collect()]
    assert got == [True, True, False, False, False]
    untagged = retention.expire_by_age(df, "pushed_at", 10, as_of, F.col("tag").isNull()).orderBy("id")
    assert [row["expire"] for row in untagged.collect()] == [False, True, False, False, False]


@pytest.mark.parametrize("rows_per_task", [10**9, 3])
def test_detect_changes(spark, rows_per_task):
    rows = [("k", 1, "a", None), ("k", 2, "a", None), ("k", 3, None, "a"), ("k", 4, None, "a"), ("k", 5, "a", "a"), ("j", 1, "a", None)]
    df = spark.createDataFrame(rows, "key string, version int, x string, y string")
    got = retention.detect_changes(df, ["key"], ["version"], ["x", "y"], rows_per_task)
    got = got.orderBy("key", "version").collect()
    assert [row["changed"] for row in got] == [True, True, False, True, False, True]


def test_alarm_is_strict(spark):
    rows = [("d", DAY + timedelta(seconds=s), v) for s, v in [(0, 1), (59, 0), (60, 1), (75, 1), (120, 0)]]
    got = alarm.dlq_alarm(spark.createDataFrame(rows, GAUGE)).orderBy("window_start").collect()
    assert [(row["total"], row["alarm"]) for row in got] == [(1, False), (2, True), (0, False)]


def test_step_series_fills_gaps(spark):
    rows = [("a", 5, 2), ("a", 5, -1), ("a", 8, 1), ("b", 1, 4), ("b", 9, -4), ("b", 50, 1)]
    df = spark.createDataFrame(rows, "queue string, tick bigint, change int")
    got = depth.step_series(df, 3, 10).orderBy("queue", "tick").collect()
    assert [row["depth"] for row in got] == [0, 0, 1, 1, 1, 2, 2, 2] + [4, 4, 4, 4, 4, 4, 0, 0]
