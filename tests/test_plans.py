"""Physical plans: pushed filters, pruned columns, number of shuffles."""

import pytest
from pyspark.sql import functions as F

from queuelens.operators import depth, lifecycle, logs, retention
from queuelens.plans import tables as t
from queuelens.session import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    paths = {}
    for name in ("sends", "receives", "acks", "log_records", "versions"):
        paths[name] = scratch(spark, name)
        getattr(t, name)(spark, sf_dir).write.parquet(paths[name])
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def test_log_query_reads_four_columns_of_matching_records(stored):
    plan = plan_of(logs.log_query(stored["log_records"], limit=10))
    assert "EqualTo(levelname,ERROR)" in plan
    assert "TakeOrderedAndProject" in plan
    assert " name:string" not in plan and ",name:string" not in plan
    assert "Exchange" not in plan


def test_ack_join_shuffles_once(stored):
    plan = plan_of(lifecycle.ack_join(stored["receives"], stored["acks"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_state_uses_hash_aggregation_and_pushes_the_moment(stored):
    plan = plan_of(
        lifecycle.message_state(stored["sends"], stored["receives"], stored["acks"], t.AS_OF, t.VISIBILITY_S)
    )
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_max" in plan and "SortAggregate" not in plan and "Window" not in plan
    for column in ("sent_at", "received_at", "acked_at"):
        assert f"LessThanOrEqual({column}," in plan
    assert "body" not in plan


def test_dead_letters_read_exhausted_receives_only(stored):
    plan = plan_of(lifecycle.dead_letters(stored["receives"], stored["acks"], t.VISIBILITY_S))
    assert "GreaterThanOrEqual(receive_count,3)" in plan
    assert "SortAggregate" not in plan


def test_retention_prunes_before_the_shuffle(stored):
    plan = plan_of(retention.retain_latest(stored["versions"]))
    assert "row_number(), 10, Partial" in plan


def test_expire_by_age_needs_no_shuffle(stored):
    old = retention.expire_by_age(stored["sends"], "sent_at", 60, t.AS_OF).filter("expire")
    plan = plan_of(old)
    assert "Exchange" not in plan and "LessThan(sent_at," in plan


def test_row_operators_stay_in_generated_code(stored):
    plan = plan_of(retention.expire_by_age(stored["sends"], "sent_at", 60, t.AS_OF))
    assert "Python" not in plan
    assert "(1) Project" in plan


def test_depth_reads_nothing_after_its_last_tick(stored):
    logs_of = (stored["sends"], stored["receives"], stored["acks"])
    plan = plan_of(depth.depth_series(*logs_of, t.TICK_S, 1_893_408, 1_893_408 + 96, t.VISIBILITY_S))
    for column in ("sent_at", "received_at", "acked_at"):
        assert f"LessThanOrEqual({column},2024-01-02T00:00)" in plan
    assert "Join" not in plan and "body" not in plan
