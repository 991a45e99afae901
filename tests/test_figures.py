"""Known totals of the derived tables at sf 0.01."""

import os

import pytest
from pyspark.sql import functions as F

from queuelens.operators import logs, messages
from queuelens.plans import tables as t
from queuelens.plans.queries import all_queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables of sf 0.01 needed")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: all_queries()[name](spark, SF)


def counts(df, column):
    return {row[0]: row[1] for row in df.groupBy(column).count().collect()}


def test_log_tables(spark):
    assert counts(t.receives(spark, SF), "receive_count") == {1: 10_000, 2: 3_200, 3: 1_200}
    assert t.acks(spark, SF).count() == 9_900
    assert counts(t.log_records(spark, SF), "levelname") == {
        "ERROR": 2_014,
        "WARNING": 2_017,
        "INFO": 3_987,
        "DEBUG": 1_982,
    }
    assert counts(t.polls(spark, SF), "kind") == {"empty": 3_988, "got": 3_998, "api_error": 2_014}
    env = t.envelopes(spark, SF)
    text = F.col("attributes")[messages.RECEIVE_COUNT]
    row = env.agg(
        F.count_if(F.col("message_id").isNull()), F.count_if(text == "x"),
        F.count_if(text.isNull()), F.count_if(F.col("body").isNull()),
    ).first()
    assert tuple(row) == (244, 233, 208, 189)


def test_acks_and_dead_letters(run):
    joined = run("ack_join")
    assert joined.filter("acked_at IS NULL").count() == 4_500
    assert joined.filter("stale_ack").count() == 100
    assert run("dead_letters").count() == run("pending_messages").count() == 200


def test_state_and_depth_agree(run):
    states = counts(run("message_state"), "state")
    assert states == {"VISIBLE": 34, "IN_FLIGHT": 3, "DELETED": 4_382, "DEAD": 89}
    moment = 1_893_408 + (13 * 24 + 12) * 4
    depth = run("depth_series")
    row = depth.agg(F.count("*"), F.sum("depth"), F.min("depth"), F.max("depth")).first()
    assert tuple(row) == (14_430, 39_599, 0, 13)
    assert depth.filter(F.col("tick") == moment).agg(F.sum("depth")).first()[0] == 34
    both = run("depth_series_in_flight").filter(F.col("tick") == moment).agg(F.sum("depth")).first()[0]
    assert both == 34 + 3


def test_replicas_and_alarm(run):
    assert counts(run("replica_recommendation"), "replicas") == {0: 2_846, 1: 8_584, 2: 2_900, 3: 100}
    alarms = run("dead_letter_alarm")
    assert (alarms.count(), alarms.filter("alarm").count(), alarms.filter("total >= 1").count()) == (3_610, 1_167, 1_252)


def test_shifted_events_give_the_shifted_series(spark, tmp_path):
    """The grid follows the data: a year later everything is a year later, and nothing is cut."""
    year = 366 * 24 * 4  # 2024 is a leap year; ticks are 15 minutes
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    later = events.withColumn("ts", F.timestamp_add("DAY", F.lit(366), F.col("ts")).cast("timestamp_ntz"))
    # Delays of the derived logs depend on the day of the month, which the shift must keep apart.
    later.write.parquet(f"{tmp_path}/events.parquet")
    first, last = t.grid(spark, "/root/testdata/sf0.001")
    sent = t.grid(spark, str(tmp_path))
    assert sent[0] == first + year and abs(sent[1] - last - year) <= 24 * 4
    series = all_queries()["depth_series"](spark, str(tmp_path))
    row = series.agg(F.min("tick"), F.max("tick"), F.count("*")).first()
    assert tuple(row) == (*sent, 5 * (sent[1] - sent[0] + 1))


def test_other_totals(run):
    assert tuple(run("empty_poll_streak").agg(F.max("streak"), F.sum("streak")).first()) == (15, 9_679)
    assert run("retain_latest").filter("expire").count() == 7_450
    assert run("change_detection").filter("changed").count() == 14_101
    assert tuple(run("body_size").agg(F.sum("n_characters"), F.sum("n_bytes")).first()) == (2_409_870, 2_472_458)
    total = run("send_summary").filter("is_total").first()
    assert (total["sent"], total["failed"]) == (10_000 - 271, 271)
    broken = run("constraint_check").select(F.explode(F.split("violations", ",")).alias("rule"))
    assert counts(broken.filter("rule <> ''"), "rule") == {"c_mktsegment_member": 592, "c_acctbal_range": 275}


def test_threshold_is_a_prefix_of_the_levels(run, spark):
    records = t.log_records(spark, SF)
    sizes = [logs.log_threshold(records, level).count() for level in ("DEBUG", "INFO", "WARNING", "ERROR")]
    assert sizes == [10_000, 8_018, 4_031, 2_014]
