"""Retry decisions whatever the split and order of micro-batches, against a loop over the receives of each message."""

import random
from datetime import datetime, timedelta

import pytest

from queuelens.session import scratch
from queuelens.sources.messages import stream_messages
from queuelens.streaming import runs
from queuelens.streaming.running import drained

DAY = datetime(2024, 1, 1)
SCHEMA = "queue string, message_id bigint, receipt_handle string, received_at timestamp_ntz, success boolean"


def looped(rows, most, ttl_s):
    failures, last, found = {}, {}, {}
    for queue, message, handle, at, success in sorted(rows, key=lambda r: (r[3], r[2])):
        key = (queue, message)
        if key in last and (at - last[key]).total_seconds() > ttl_s:
            failures[key] = 0
        last[key] = at
        if success:
            failures[key] = 0
            continue
        failures[key] = failures.get(key, 0) % most + 1
        found[queue, message, handle] = (failures[key], "dead" if failures[key] == most else "retry")
    return found


def made(rng, n):
    """A hot message with a third of all receives, ties of time among them, and many others."""
    rows = []
    for k in range(n):
        message = 1 if k % 3 == 0 else rng.randint(2, 9)
        at = DAY + timedelta(minutes=rng.choice([rng.randint(0, 4_000), 5 * rng.randint(0, 30)]))
        rows.append((rng.choice(["q", "r"]) if message > 1 else "q", message, f"h{k}", at, rng.choice([False] * 6 + [True, None])))
    return rows


def decided(spark, path):
    return {(r["queue"], r["message_id"], r["receipt_handle"]): (r["receive_count"], r["route"]) for r in runs.latest_decisions(spark, path).collect()}


@pytest.mark.parametrize("seed, split, order", [(1, 1, "time"), (2, 4, "random"), (3, 3, "reversed")])
def test_any_split_and_order_gives_the_same(spark, seed, split, order):
    """The sink on micro-batches of its own making; the last of them replayed, too."""
    rng = random.Random(seed)
    rows = made(rng, 150)
    ttl = 6 * 3600
    rows.sort(key=lambda r: rng.random() if order == "random" else r[3], reverse=order == "reversed")
    out = scratch(spark, "runs")
    sink = runs.retry_sink(out, 3, ttl, stretch_s=4 * 3600, rows_per_task=None if seed == 1 else 20)
    size = -(-len(rows) // split)
    for number, start in enumerate(range(0, len(rows), size)):
        part = spark.createDataFrame(rows[start : start + size], SCHEMA)
        sink(part, number)
        seen = [(*r[:4], bool(r[4])) for r in rows[: start + size]]
        assert decided(spark, out) == looped(seen, 3, ttl)
    sink(part, number)
    assert decided(spark, out) == looped(seen, 3, ttl)


def test_a_late_success_corrects_later_stretches(spark):
    """Four failures on four days; then the success between the first two turns up."""
    fails = [("q", 1, f"h{k}", DAY + timedelta(days=k), False) for k in range(4)]
    out = scratch(spark, "runs")
    sink = runs.retry_sink(out, 3, 10**7)
    sink(spark.createDataFrame(fails, SCHEMA), 0)
    assert [decided(spark, out)["q", 1, f"h{k}"] for k in range(4)] == [(1, "retry"), (2, "retry"), (3, "dead"), (1, "retry")]
    sink(spark.createDataFrame([("q", 1, "late", DAY + timedelta(hours=1), True)], SCHEMA), 1)
    assert [decided(spark, out)["q", 1, f"h{k}"] for k in range(4)] == [(1, "retry"), (1, "retry"), (2, "retry"), (3, "dead")]
    changed = spark.read.parquet(f"{out}/decisions/batches/batch_id=1").collect()
    assert {r["receipt_handle"] for r in changed} == {"h0", "h1", "h2", "h3"}


def test_stream_and_its_restart(spark):
    rows = [(*r[:4], bool(r[4])) for r in made(random.Random(7), 60)]
    src, out = scratch(spark, "src"), scratch(spark, "runs")
    for part in (rows[40:], rows[:40]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second run starts from the checkpoint and adds nothing
            drained(runs.retry_in_any_order(stream_messages(spark, src, None, schema=spark.read.parquet(src).schema), out, ttl_s=9_000), 900)
    assert decided(spark, out) == looped(rows, 3, 9_000)


def test_nothing_received(spark):
    out = scratch(spark, "runs")
    assert runs.latest_decisions(spark, out).collect() == []
    runs.retry_sink(out)(spark.createDataFrame([], SCHEMA), 0)
    assert runs.latest_decisions(spark, out).collect() == []


def test_only_messages_in_several_stretches_are_carried(spark, monkeypatch):
    """What most messages never need is not worked out for them; the decisions are the same."""
    carried, plain = [], runs.carries

    def counted(found, ttl_s, rows_per_task):
        carried.append({r["message_id"] for r in found.collect()})
        return plain(found, ttl_s, rows_per_task)

    monkeypatch.setattr(runs, "carries", counted)
    rows = [("q", k // 2, f"h{k}", DAY + timedelta(minutes=k % 2), k % 5 == 0) for k in range(60)]
    rows += [("q", 7, f"late{k}", DAY + timedelta(hours=5 * k), False) for k in (1, 2)]
    out = scratch(spark, "runs")
    sink = runs.retry_sink(out, 3, 86_400, stretch_s=4 * 3600)
    for number in (0, 1):
        sink(spark.createDataFrame(rows[number::2], SCHEMA), number)
    assert decided(spark, out) == looped(rows, 3, 86_400)
    assert set().union(*carried) <= {7}
