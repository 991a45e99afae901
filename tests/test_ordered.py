"""Running values: plain windows, and huge groups cut into segments."""

import random

import pytest
from pyspark.sql import functions as F

from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import hot_groups, join_unique

SCHEMA = "g string, at int, id int, x int"


def make_rows(seed=7, n=6000):
    """A third of all rows in one group, a sixth under a NULL key, the rest small."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        draw = rng.random()
        group = "hot" if draw < 0.34 else None if draw < 0.5 else f"g{rng.randrange(400)}"
        rows.append((group, rng.randrange(300), i, rng.choice([None, *range(20)])))
    return rows


def expected(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    want = []
    for members in groups.values():
        total, top = None, None
        for i, row in enumerate(members):
            x = row[3]
            total = total if x is None else (total or 0) + x
            top = top if x is None else x if top is None else max(top, x)
            before = members[i - 1][3] if i else None
            after = members[i + 1][3] if i + 1 < len(members) else None
            want.append((*row, i + 1, total or 0, top, before, after))
    return sorted(want, key=lambda r: r[2])


@pytest.mark.parametrize("rows_per_task", [150, 10**9])
def test_running_values(spark, rows_per_task):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    runs = Ordered(df, ["g"], ["at", "id"], rows_per_task)
    assert (runs.hot is not None) == (rows_per_task == 150)
    if runs.hot is not None:
        assert runs.hot.select("_segment").distinct().count() > 10
    runs.row_number("n").running_sum("total", F.coalesce("x", F.lit(0))).running_max("top", F.col("x"))
    runs.previous("before", F.col("x")).following("after", F.col("x"))
    got = sorted((tuple(r) for r in runs.frame().collect()), key=lambda r: r[2])
    assert got == expected(rows)


def test_hot_groups_finds_large_groups_only(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA).repartition(8)
    hot = hot_groups(df, ["g"], 500)
    counts = df.groupBy(F.xxhash64("g").alias("h")).count().filter("count > 500").collect()
    assert set(hot) == {row["h"] for row in counts}
    assert len(hot) == 2
    assert hot_groups(df.limit(0), ["g"], 500) == {}


def test_groups_of_a_ten_thousandth_of_the_rows_are_found(spark):
    """Ten groups of 0.01 % each, twice the limit, among keys that occur once."""
    key = F.when(F.col("id") % 10_000 < 10, F.col("id") % 10_000 - 10).otherwise(F.col("id"))
    df = spark.range(0, 2_000_000, numPartitions=8).select(key.alias("g"))
    want = {row["h"] for row in spark.range(-10, 0).select(F.xxhash64("id").alias("h")).collect()}
    assert set(hot_groups(df, ["g"], 100)) == want


def test_no_hot_group_is_one_plain_window(spark):
    df = spark.createDataFrame(make_rows(n=100), SCHEMA)
    plan = Ordered(df, ["g"], ["at", "id"]).row_number("n").frame()._jdf.queryExecution().toString()
    assert "Join" not in plan and "Union" not in plan


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_join_with_unique_side(spark, how):
    left = spark.createDataFrame(make_rows(), SCHEMA).repartition(8)
    right = left.select("g").distinct().filter("g IS NULL OR g NOT LIKE '%7'").withColumn("y", F.length("g"))
    split = join_unique(left, right, ["g"], how, 500)
    assert "strategy=broadcast" in split._jdf.queryExecution().toString()
    want = sorted(map(str, left.join(right, ["g"], how).collect()))
    assert sorted(map(str, split.collect())) == want
