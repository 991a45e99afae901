"""Limits on the change of workers, against a loop over ticks."""

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from queuelens.operators import limits, scaling
from queuelens.operators.limits import RateLimit

SCHEMA = "queue string, tick bigint, replicas bigint"


def walked(wanted, up, down, tick_s, most, start):
    """The rule once more, over a list that keeps the past."""
    past = [start] * 50
    for goal in wanted:
        now = past[-1]
        if goal is None:
            past.append(now)
            continue
        goal = min(max(goal, 0), most)
        ago = lambda limit: past[-max(1, ceil(limit.period_s / tick_s))]
        if goal > now and up:
            ceiling = max(ago(x) + x.value if x.kind == "pods" else ceil(ago(x) * (100 + x.value) / 100) for x in up)
            goal = max(now, min(goal, ceiling))
        elif goal < now and down:
            floor = min(ago(x) - x.value if x.kind == "pods" else ago(x) * (100 - x.value) // 100 for x in down)
            goal = min(now, max(goal, floor))
        past.append(goal)
    return past[50:]


POLICIES = [
    (limits.SCALE_UP, limits.SCALE_DOWN, 5, 0),
    ([RateLimit("pods", 1, 15)], [RateLimit("percent", 50, 30)], 5, 0),
    ([RateLimit("percent", 100, 15), RateLimit("pods", 2, 30)], [RateLimit("pods", 1, 45)], 7, 2),
    ([], [RateLimit("pods", 0, 15)], 3, 1),
    ([RateLimit("pods", 3, 40)], [], 9, 9),
]


@pytest.mark.parametrize("up, down, most, start", POLICIES)
@pytest.mark.parametrize("fan", [5, 64])
def test_against_the_loop(spark, monkeypatch, up, down, most, start, fan):
    """One queue of many blocks and some small ones; gaps, negative ticks and NULL among them."""
    monkeypatch.setattr(limits, "FAN", fan)
    rng = random.Random(most * fan)
    groups = {"hot": range(-300, 300), "few": range(5), "gaps": [1, 2, 9, 400, 401], None: range(10)}
    rows = {q: [(q, t, rng.choice([0, 0, 1, most, most + 3, -1, None, rng.randint(0, most)])) for t in ticks] for q, ticks in groups.items()}
    flat = [r for g in rows.values() for r in g] + [("few", None, 3)]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, SCHEMA).withColumn("limit", F.lit("theirs"))
    got = {}
    for r in limits.limit_changes(df, 15, up, down, most, start).collect():
        assert r["limit"] == "theirs"
        got.setdefault(r["queue"], {})[r["tick"]] = r["limited"]
    for q, group in rows.items():
        assert [got[q][t] for _, t, _ in group] == walked([w for *_, w in group], up, down, 15, most, start)
    assert sum(map(len, got.values())) == len(flat) - 1


def test_the_limits_bind_and_the_own_values_do_not(spark):
    jump = [(("q", t, 5 if 3 <= t < 9 else 0)) for t in range(16)]
    df = spark.createDataFrame(jump, SCHEMA)

    def ran(**limit):
        return [r["limited"] for r in limits.limit_changes(df, 15, **limit).orderBy("tick").collect()]

    assert ran() == [w for *_, w in jump]
    assert ran(up=[RateLimit("pods", 1, 15)]) == [0, 0, 0, 1, 2, 3, 4, 5, 5, 0, 0, 0, 0, 0, 0, 0]
    assert ran(down=[RateLimit("pods", 2, 15)])[8:13] == [5, 3, 1, 0, 0]
    assert ran(down=[RateLimit("percent", 50, 30)])[8:14] == [5, 2, 2, 1, 1, 0]


def test_one_queue_spreads_over_tasks(spark):
    """Equal shares: blocks of a queue are dealt over all tasks, with no window and no Python."""
    n = 64 * 400
    df = spark.range(n).select(F.lit("q").alias("queue"), F.col("id").alias("tick"), (F.col("id") * 7919 % 6).alias("replicas"))
    out = limits.limit_changes(df, 15, [RateLimit("pods", 1, 15)], [RateLimit("pods", 1, 30)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    want = walked([k * 7919 % 6 for k in range(n)], [RateLimit("pods", 1, 15)], [RateLimit("pods", 1, 30)], 15, 5, 0)
    assert [r["limited"] for r in out.orderBy("tick").collect()] == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert limits.limit_changes(empty, 15).collect() == []
    with pytest.raises(ValueError, match="states"):
        limits.limit_changes(empty, 15, up=[RateLimit("pods", 1, 600)])
    with pytest.raises(ValueError, match="no such limit"):
        limits.limit_changes(empty, 15, up=[RateLimit("cpus", 1, 15)])


@pytest.mark.parametrize("span", [1, 4, 60])
def test_trailing_ranges_of_a_huge_queue(spark, span):
    """Recommendations with a queue cut into segments shorter than the range, by policy and by row."""
    rng = random.Random(span)
    rows = [("hot", t, rng.choice([0, 0, 0, 7, 23])) for t in range(200)] + [("few", t, t % 3) for t in range(8)]
    df = spark.createDataFrame(rows, "queue string, tick bigint, depth bigint").repartition(4)
    policy = scaling.Policy(stabilization_s=15 * span, cooldown_s=45)
    plain = scaling.recommend_replicas(df, policy, 15, rows_per_task=None)
    split = scaling.recommend_replicas(df, policy, 15, rows_per_task=20)
    key = lambda r: (r["queue"], r["tick"])
    assert sorted(split.collect(), key=key) == sorted(plain.collect(), key=key)
    own = df.withColumns({"env": F.lit("prod"), **{f: F.lit(v) for f, v in policy._asdict().items()}})
    own = own.withColumn("stabilization_s", F.when(F.col("tick") % 2 == 0, 15).otherwise(F.col("stabilization_s")))
    plain = scaling.recommend_replicas(own, None, 15, 15 * span, None)
    split = scaling.recommend_replicas(own, None, 15, 15 * span, 20)
    assert sorted(split.collect(), key=key) == sorted(plain.collect(), key=key)
    assert plain.count() == len(rows)


def test_trailing_range_holds_equal_places_of_the_next_segment(spark):
    from queuelens.operators.ordered import Ordered

    rows = [("k", i, i // 7) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, id bigint, at bigint").repartition(3)
    got = Ordered(df, ["key"], ["at", "id"], 5).trailing("n", F.count("*"), "at", 2).frame()
    want = Ordered(df, ["key"], ["at", "id"], None).trailing("n", F.count("*"), "at", 2).frame()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_steps_over_a_long_grid(spark):
    from queuelens.operators.depth import step_series

    rng = random.Random(5)
    rows = [("hot", rng.randint(-5, 300), rng.choice([1, -1])) for _ in range(900)] + [("few", 7, 2), ("late", 400, 1)]
    df = spark.createDataFrame(rows, "queue string, tick bigint, change int")
    plain, split = (step_series(df, 0, 250, rows_per_task=n) for n in (None, 30))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() == 2 * 251
