"""Retention rule sets, the pruned log store, address ranges, and tracebacks of handlers."""

import ipaddress
import random
import traceback
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from queuelens.functions import handlers
from queuelens.operators import addresses, logs, retention, rules
from queuelens.operators.retention import RetentionRule
from queuelens.plans import tables as t
from queuelens.schemas import VERSION
from queuelens.session import scratch
from queuelens.sources import log_store, sinks

DAY = datetime(2024, 1, 1)


def applied(rows, rule_set, as_of):
    """Claim and expiry by hand."""
    out, claimed = {}, {}
    for repo, i, pushed, tag in rows:
        for rule in sorted(rule_set):
            if tag is None if rule.untagged else (not rule.prefixes or (tag or "").startswith(rule.prefixes)):
                claimed.setdefault((repo, rule), []).append((pushed, i))
                out[i] = (rule.priority, False)
                break
        else:
            out[i] = (None, False)
    for (repo, rule), members in claimed.items():
        known = [m for m in members if m[0] is not None] if rule.kind == "age" else members
        if rule.kind == "age":
            gone = [m for m in known if m[0] < as_of - timedelta(seconds=rule.limit)]
        elif repo is None:
            gone = []
        else:
            gone = sorted(members, reverse=True)[rule.limit :]
        for _, i in gone:
            out[i] = (rule.priority, True)
    return out


RULE_SETS = [
    retention.RULES,
    [RetentionRule(1, "count", 2, ("v",)), RetentionRule(2, "count", 3, ("v", "sha-")), RetentionRule(9, "age", 86_400 * 5)],
    [RetentionRule(2, "count", 4), RetentionRule(1, "age", 86_400 * 3, untagged=True)],
    [RetentionRule(3, "count", 0, ("tmp",)), RetentionRule(5, "count", 1_200, ("v",))],
    [],
]


@pytest.mark.parametrize("k", range(len(RULE_SETS)))
def test_rule_sets(spark, k):
    rng = random.Random(k)
    tags = ["v1", "v2", "sha-a", "tmp", "latest", None, ""]
    rows = [(rng.choice(["r", "s", None]), i, DAY + timedelta(hours=rng.randint(0, 240)), rng.choice(tags)) for i in range(120)]
    if k == 3:
        rows += [("r", 1000 + i, DAY + timedelta(minutes=i), "v") for i in range(1_300)]
    rows += [("r", 998, DAY, "v1"), ("r", 999, DAY, "v1")]
    as_of = DAY + timedelta(days=10)
    df = spark.createDataFrame(rows, VERSION)
    got = retention.apply_rules(df, RULE_SETS[k], str(as_of), rows_per_task=None if k % 2 else 100)
    assert got.columns == [*df.columns, "rule", "expire"]
    assert {r["id"]: (r["rule"], r["expire"]) for r in got.collect()} == applied(rows, RULE_SETS[k], as_of)


def test_rules_as_a_table(spark):
    rows = [(1, "count", 10, ["v", "sha-", "latest"], False), (2, "age", 86_400, None, True)]
    table = spark.createDataFrame(rows, "priority int, kind string, limit int, prefixes array<string>, untagged boolean")
    assert sorted(retention.rules_from(table)) == retention.RULES
    empty = spark.createDataFrame([], VERSION)
    for wrong in ([RetentionRule(1, "count", 1), RetentionRule(1, "age", 1)], [RetentionRule(1, "size", 1)], [RetentionRule(1, "age", -1)]):
        with pytest.raises(ValueError):
            retention.apply_rules(empty, wrong, str(DAY))
    assert retention.apply_rules(empty, retention.RULES, str(DAY)).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_store_reads_only_what_is_asked_for(spark, sf_dir):
    records = t.log_records(spark, sf_dir)
    path, text = scratch(spark, "store"), scratch(spark, "text")
    log_store.append_log(records, path, rows_per_file=200)
    sinks.write_log(records, text)
    week = log_store.read_log_store(spark, path, ["ERROR"], "2024-01-08 06:00:00", "2024-01-15")
    plan = plan_of(week)
    assert "PartitionFilters: [" in plan and "levelname" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(asctime" in plan
    files = {r["f"] for r in week.select(F.input_file_name().alias("f")).distinct().collect()}
    assert all("levelname=ERROR" in f for f in files)
    assert {f.split("day=")[1][:10] for f in files} <= {f"2024-01-{d:02}" for d in range(8, 15)}
    whole = records.filter("levelname = 'ERROR' AND asctime >= '2024-01-08 06:00:00' AND asctime < '2024-01-15'")
    assert sorted(map(tuple, logs.log_query(week).collect())) == sorted(map(tuple, logs.log_query(whole).collect()))
    assert week.count() > 0 and log_store.read_log_store(spark, path).count() == spark.read.text(text).count()


def test_log_store_compacts_and_keeps_odd_records(spark):
    path, into = scratch(spark, "store"), scratch(spark, "store")
    assert log_store.read_log_store(spark, path, ["ERROR"]).collect() == []
    rows = [(DAY + timedelta(hours=h), level, f"m{h}") for h in range(30) for level in ("INFO", "ERROR")] + [(None, "ERROR", "x"), (DAY, None, "y")]
    for k in range(0, len(rows), 10):
        log_store.append_log(spark.createDataFrame(rows[k : k + 10], "asctime timestamp_ntz, levelname string, message string"), path)
    log_store.compacted_log(spark, path, into)
    old, new = (log_store.read_log_store(spark, p) for p in (path, into))
    assert sorted(map(str, old.collect())) == sorted(map(str, new.collect())) and old.count() == len(rows)
    count = lambda df: df.select(F.input_file_name()).distinct().count()
    assert count(new) == 6 < count(old)  # days and levels, those without among them
    assert new.columns == logs.LOG_RECORD.names


def test_address_blocks(spark):
    texts = ["10.0.0.0/8", "10.1.2.3/8", "1.2.3.4", "1.2.3.4/32", "0.0.0.0/0", "255.255.255.255/31", "256.1.1.1/8", "1.2.3/8", "1.2.3.4/33", "01.2.3.4/8", "x", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "block string")
    checked = rules.check_rows(df, [addresses.valid_block("block")]).withColumn("range", addresses.address_range(F.col("block")))
    for row in checked.collect():
        try:
            net = ipaddress.ip_network(row["block"] or "", strict=False)
            want = (int(net.network_address), int(net.broadcast_address))
        except ValueError:
            want = None
        assert (tuple(row["range"]) if row["range"] else None) == want, row
        assert row["is_valid"] == (want is not None and "/" in row["block"])


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_overlaps_against_all_pairs(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(addresses, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(4)

    def some(n):
        out = []
        for k in range(n):
            low = rng.choice([0, rng.randrange(2**32), rng.randrange(2**16), 2**32 - 1])
            out.append((k, low, min(2**32 - 1, low + rng.choice([0, 1, 255, rng.randrange(2 ** rng.randint(1, 32))]))))
        return out

    rows, table = some(120), some(80) + [(80, 0, 2**32 - 1), (81, 5, 5), (81, 5, 5)]
    odd = [(500, None, 3), (501, 9, 3), (502, -1, 3), (503, 0, 2**32)]
    df = spark.createDataFrame(rows + odd, "id int, low bigint, high bigint")
    ranges = spark.createDataFrame(table + odd, "id int, low bigint, high bigint")
    got = sorted((r["id"], r["range_id"], r["contained"]) for r in addresses.overlaps(df, ranges).collect())
    want = [(i, j, c <= a and b <= d) for i, a, b in rows for j, c, d in table if a <= d and c <= b]
    assert got == sorted(want)


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_overlap_counts_against_all_pairs(spark, rows_per_task):
    rng = random.Random(9)

    def some(n):
        lows = [rng.choice([0, 2**32 - 1, 2**31, rng.randrange(2**32), rng.randrange(2**12)]) for _ in range(n)]
        return [(k, a, min(2**32 - 1, a + rng.choice([0, 1, 255, rng.randrange(2 ** rng.randint(1, 32))]))) for k, a in enumerate(lows)]

    rows, table = some(60) + [(60, 0, 2**32 - 1)], some(50) + [(50, 0, 2**32 - 1), (51, 5, 5), (51, 5, 5), (None, 5, 9)]
    odd = [(500, None, 3), (501, 9, 3), (502, -1, 3), (503, 0, 2**32)]
    df = spark.createDataFrame(rows + rows[:5] + odd, "id int, low bigint, high bigint")
    ranges = spark.createDataFrame(table + odd, "id int, low bigint, high bigint")
    want = set()
    for _, a, b in rows:
        met = [(k, c, d) for k, c, d in table if a <= d and c <= b]
        if met:
            first = min((k for k, _, _ in met if k is not None), default=None)
            want.add((a, b, len(met), sum(c <= a and b <= d for _, c, d in met), first))
    got = addresses.overlap_counts(df, ranges, "id", rows_per_task).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_address_ranges_makes_no_pairs(spark, tmp_path):
    """All blocks and all ranges meet: what the query writes down grows with their number, not with its square."""
    written = []
    for n in (200, 800):
        spark.range(50, 50 * n + 1, 50).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/{n}/customer.parquet")
        spark.range(n).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/{n}/supplier.parquet")
        plan = queries()["address_ranges"](spark, f"{tmp_path}/{n}")
        assert plan.count() == n
        assert "_bin" not in plan._jdf.queryExecution().toString()
        written.append(plan.agg(F.sum("overlapping")).first()[0])
    assert written[1] > 8 * written[0]  # so many pairs there would be


def deep(n, problem):
    if n:
        deep(n - 1, problem)
    raise problem


def chained():
    try:
        deep(1, KeyError("inner"))
    except KeyError as inner:
        raise RuntimeError("outer") from inner


@pytest.mark.parametrize("call", [
    lambda: deep(0, ValueError("a")), lambda: deep(3, ValueError("b\nc")), lambda: deep(2, ValueError()), lambda: deep(1, KeyError("k")),
    chained, lambda: compile("1 +", "x", "exec"), lambda: deep(0, ExceptionGroup("g", [ValueError("v")])), lambda: {}["gone"], lambda: int("x"),
    lambda: deep(400, ValueError("d")), lambda: deep(0, type("Own", (Exception,), {"__module__": "some.place"})("o")),
])
def test_traces_are_those_of_the_traceback_module(call):
    known = {}
    for _ in range(3):
        try:
            call()
        except Exception as problem:
            assert handlers._trace(problem, known) == "".join(traceback.format_exception(problem))
