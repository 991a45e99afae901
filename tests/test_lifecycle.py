"""Message life against a plain simulation of each single message."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuelens.functions.scalars import epoch_micros
from queuelens.operators import lifecycle
from queuelens.operators.depth import depth_series
from queuelens.schemas import ACK_LOG, RECEIVE_LOG, SEND_LOG

START = datetime(2024, 1, 1)
VISIBILITY, TICK, MAX = 30, 15, 3
FIRST = int(START.timestamp() - datetime(1970, 1, 1).timestamp()) // TICK
LAST = FIRST + 60


def at(seconds):
    return START + timedelta(seconds=seconds)


def make_logs(seed=3, n=300):
    """Logs with expiries, early redeliveries, stale, late and repeated acks."""
    rng = random.Random(seed)
    sends, receives, acks = [], [], []
    for m in range(n):
        queue = "big" if m % 3 == 0 else f"q{m % 7}"
        now = rng.randrange(0, 300) + rng.choice([0, 0.5])
        sends.append((queue, m, at(now), f"body {m}"))
        pending = []
        for k in range(1, MAX + 1):
            if rng.random() < 0.15:
                break
            # Mostly after the message is shown again, sometimes sooner.
            gap = rng.choice([0, 1, 7, 40]) if k == 1 else rng.choice([VISIBILITY, VISIBILITY + 11, 12])
            now += gap
            handle = f"r-{m}-{k}"
            receives.append((queue, m, k, handle, at(now)))
            for old in pending:  # acks that come after this receive
                acks.append((queue, m, old, at(now + rng.choice([0, 3]))))
            pending = []
            draw = rng.random()
            if draw < 0.35:
                acks.append((queue, m, handle, at(now + rng.choice([0.5, 5, 29, 45]))))
                if rng.random() < 0.3:
                    acks.append((queue, m, handle, at(now + 60)))
                break
            if draw < 0.55:
                pending = [handle]
    return sends, receives, acks


def simulate(sent, received, acked, moment):
    """State of one message at ``moment``, by walking through its log."""
    if sent > moment:
        return None
    state = "VISIBLE"
    seen = sorted(r for r in received if r[0] <= moment)
    for i, (time, k, handle) in enumerate(seen):
        following = seen[i + 1][0] if i + 1 < len(seen) else None
        ends = time + timedelta(seconds=VISIBILITY)
        ack = min((a for a, h in acked if h == handle and a <= moment), default=None)
        if ack is not None and following is not None and following <= ack:
            ack = None
        if ack is not None and following is None and k >= MAX and ack >= ends:
            ack = None
        if ack is not None:
            return "DELETED"
        if following is None:
            state = "IN_FLIGHT" if moment < ends else "DEAD" if k >= MAX else "VISIBLE"
    return state


@pytest.fixture(scope="module")
def logs(spark):
    sends, receives, acks = make_logs()
    frames = (
        spark.createDataFrame(sends, SEND_LOG),
        spark.createDataFrame(receives, RECEIVE_LOG),
        spark.createDataFrame(acks, ACK_LOG),
    )
    by_message = {}
    for queue, m, time, _ in sends:
        by_message[m] = (queue, time, [], [])
    for _, m, k, handle, time in receives:
        by_message[m][2].append((time, k, handle))
    for _, m, handle, time in acks:
        by_message[m][3].append((time, handle))
    return frames, by_message


@pytest.mark.parametrize("seconds", [0, 97.5, 150, 210, 330, 10_000])
def test_state_and_depth_at_a_moment(logs, seconds):
    (sends, receives, acks), by_message = logs
    moment = at(seconds)
    states = lifecycle.message_state(sends, receives, acks, str(moment), VISIBILITY, MAX)
    got = {row["message_id"]: row for row in states.collect()}
    want = {m: simulate(*parts, moment) for m, (_, *parts) in by_message.items()}
    want = {m: state for m, state in want.items() if state}
    assert {m: row["state"] for m, row in got.items()} == want
    for m, row in got.items():
        seen = [r for r in by_message[m][2] if r[0] <= moment]
        assert row["receive_count"] == len(seen)
        assert row["redelivered"] == (len(seen) > 1)
        assert (row["visible_again_at"] is not None) == (row["state"] == "IN_FLIGHT")
    counts = Counter((by_message[m][0], state) for m, state in want.items())
    for row in lifecycle.queue_depth(states).collect():
        for state in ("VISIBLE", "IN_FLIGHT", "DELETED", "DEAD"):
            assert row[state.lower()] == counts[row["queue"], state]


@pytest.mark.parametrize("rows_per_task", [10**9, 2])
@pytest.mark.parametrize("in_flight", [False, True])
def test_depth_series(logs, in_flight, rows_per_task):
    (sends, receives, acks), by_message = logs
    series = depth_series(
        sends, receives, acks, TICK, FIRST, LAST, VISIBILITY, MAX, in_flight, rows_per_task
    )
    got = {(row["queue"], row["tick"]): row["depth"] for row in series.collect()}
    counted = {"VISIBLE", "IN_FLIGHT"} if in_flight else {"VISIBLE"}
    queues = {queue for queue, *_ in by_message.values()}
    want = {(queue, tick): 0 for queue in queues for tick in range(FIRST, LAST + 1)}
    for queue, *parts in by_message.values():
        for tick in range(FIRST, LAST + 1):
            if simulate(*parts, at((tick - FIRST) * TICK)) in counted:
                want[queue, tick] += 1
    assert got == want


def test_depth_series_keeps_what_came_before_its_start(logs):
    (sends, receives, acks), _ = logs
    arguments = (sends, receives, acks, TICK)
    whole = depth_series(*arguments, FIRST, LAST, VISIBILITY, MAX)
    later = depth_series(*arguments, FIRST + 9, LAST, VISIBILITY, MAX)
    assert sorted(whole.filter(F.col("tick") >= FIRST + 9).collect()) == sorted(later.collect())


def test_dead_letters(logs):
    (_, receives, acks), by_message = logs
    dead = lifecycle.dead_letters(receives, acks, VISIBILITY, MAX).collect()
    end = at(10_000)
    want = {m for m, (_, *parts) in by_message.items() if simulate(*parts, end) == "DEAD"}
    assert len(dead) == len(want) > 10
    assert {row["message_id"] for row in dead} == want
    for row in dead:
        assert row["dead_letter_queue"] == row["queue"] + "-dlq"
        assert row["dead_at"] == max(r[0] for r in by_message[row["message_id"]][2]) + timedelta(
            seconds=VISIBILITY
        )


@pytest.mark.parametrize("rows_per_task", [10**9, 2])
def test_ack_join_and_pending(logs, rows_per_task):
    (sends, receives, acks), by_message = logs
    joined = lifecycle.ack_join(receives, acks, rows_per_task)
    got = {row["receipt_handle"]: row for row in joined.collect()}
    removed = set()
    for m, (_, _, received, acked) in by_message.items():
        received = sorted(received)
        for i, (_, _, handle) in enumerate(received):
            ack = min((a for a, h in acked if h == handle), default=None)
            following = received[i + 1][0] if i + 1 < len(received) else None
            row = got.pop(handle)
            assert (row["acked_at"], row["next_received_at"]) == (ack, following)
            stale = ack is not None and following is not None and following <= ack
            assert row["stale_ack"] == stale
            if ack is not None and not stale:
                removed.add(m)
    assert not got
    pending = lifecycle.pending_messages(sends, lifecycle.valid_acks(joined), rows_per_task).collect()
    assert {row["message_id"] for row in pending} == set(by_message) - removed
    assert len(pending) == len(by_message) - len(removed)


def test_hot_message_with_one_missing_handle(spark):
    """A third of all receives belong to one message, many without a handle of their own."""
    receives = [("q", 0, 1, "" if i % 2 else f"h{i}", at(i)) for i in range(400)]
    receives += [("q", i, 1, f"r{i}", at(i)) for i in range(1, 801)]
    acks = [("q", 0, "", at(5)), ("q", 0, "", at(3)), ("q", 0, "h10", at(10.5))]
    acks += [("q", i, f"r{i}", at(i + 1)) for i in range(1, 801, 2)]
    frames = spark.createDataFrame(receives, RECEIVE_LOG), spark.createDataFrame(acks, ACK_LOG)
    plain = lifecycle.ack_join(*frames, 10**9)
    split = lifecycle.ack_join(*frames, 50)
    assert Counter(plain.collect()) == Counter(split.select(plain.columns).collect())
    assert plain.count() == 1200
    numbered = lifecycle.attempt_number(frames[0], 50)
    assert Counter(numbered.collect()) == Counter(lifecycle.attempt_number(frames[0]).collect())


def test_retry_profile_and_empty_logs(spark, logs):
    (sends, receives, acks), by_message = logs
    got = {row["receive_count"]: row["messages"] for row in lifecycle.retry_profile(receives).collect()}
    assert got == Counter(len(r) for _, _, r, _ in by_message.values() if r)
    none = receives.limit(0), acks.limit(0)
    states = lifecycle.message_state(sends, *none, str(at(10_000)), VISIBILITY)
    assert {row["state"] for row in states.collect()} == {"VISIBLE"}
    assert lifecycle.ack_join(*none).count() == 0
    assert lifecycle.dead_letters(*none, VISIBILITY).count() == 0


def test_epoch_micros_is_utc(spark):
    df = spark.range(1).select(epoch_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("t"))
    assert df.first()["t"] == 1_704_067_200_000_000


@pytest.mark.parametrize("done", [True, False])
def test_pending_with_one_id_on_many_sends(spark, done):
    sends = [("q", 0, at(i), "again") for i in range(500)] + [("q", i, at(i), "once") for i in range(1, 900)]
    df = spark.createDataFrame(sends, SEND_LOG)
    acked = spark.createDataFrame([("q", i) for i in range(0 if done else 1, 450)] * 2, "queue string, message_id bigint")
    got = lifecycle.pending_messages(df, acked, 100)
    assert Counter(r["message_id"] for r in got.collect()) == Counter(
        m for _, m, *_ in sends if m >= 450 or (m == 0 and not done)
    )
