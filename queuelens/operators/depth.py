"""Queue depth over time, and gauges that go up and down in general."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.scalars import plus_seconds, tick_at_or_after, tick_time
from queuelens.operators.lifecycle import ack_join
from queuelens.operators.messages import MAX_RECEIVE_COUNT
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK


def step_series(
    changes: DataFrame, start: int, end: int, value: str = "depth", rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Running total of ``change`` per queue at every tick from start to end.

    ``changes`` (queue, tick, change) may hold any number of rows: they are first
    summed per queue and tick, so the window only sees ticks at which something
    changed. The total stands until the next such tick, which fills the grid
    without a join. Changes before ``start`` count into the opening total. Ticks of a queue fit one task
    as long as there are at most ``rows_per_task`` of them in all; beyond, a queue with more is split.
    """
    at_tick = (
        changes.filter(F.col("tick") <= end)
        .groupBy("queue", F.greatest("tick", F.lit(start)).alias("tick"))
        .agg(F.sum("change").alias("change"))
    )
    long = rows_per_task is not None and end - start + 1 > rows_per_task
    steps = (
        Ordered(at_tick, ["queue"], ["tick"], rows_per_task if long else None)
        .running_sum("total", F.col("change"))
        .following("next_tick", F.col("tick"))
        .previous("last_tick", F.col("tick"))
        .frame()
    )
    stands_from = F.when(F.col("last_tick").isNull(), F.lit(start)).otherwise(F.col("tick"))
    stands_to = F.coalesce(F.col("next_tick") - 1, F.lit(end))
    return steps.withColumn("at", F.explode(F.sequence(stands_from, stands_to))).select(
        "queue",
        F.col("at").alias("tick"),
        F.when(F.col("at") < F.col("tick"), F.lit(0)).otherwise(F.col("total")).cast("bigint").alias(value),
    )


def depth_series(
    sends: DataFrame,
    receives: DataFrame,
    acks: DataFrame,
    tick_s: int,
    start: int,
    end: int,
    visibility_s: int,
    max_receive_count: int = MAX_RECEIVE_COUNT,
    include_in_flight: bool = False,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Messages waiting per queue at every tick; (queue, tick, depth).

    A message counts from the first tick at or after it was sent. It stops
    counting while a receive hides it and after it is deleted or dead. With
    ``include_in_flight`` hidden messages count too.
    """
    # What was logged after the last tick cannot count; the filter reaches the scans.
    ends_at = tick_time(F.lit(end), tick_s)
    sends = sends.filter(F.col("sent_at") <= ends_at)
    receives = receives.filter(F.col("received_at") <= ends_at)
    acks = acks.filter(F.col("acked_at") <= ends_at)

    received = F.col("received_at")
    hidden_until = plus_seconds(received, visibility_s)
    last_allowed = (F.col("receive_count") >= max_receive_count) & F.col("next_received_at").isNull()
    deleted_at = F.when(
        F.col("acked_at").isNotNull()
        & ~F.col("stale_ack")
        & (~last_allowed | (F.col("acked_at") < hidden_until)),
        F.col("acked_at"),
    )
    # A receive that is not settled while hidden shows the message again, unless
    # it was the last allowed one. The next receive may come sooner than that.
    reappears = F.coalesce(deleted_at >= hidden_until, F.lit(True)) & ~last_allowed
    shown_at = F.when(reappears, F.least(hidden_until, F.col("next_received_at")))

    def change(at, amount):
        return F.struct(at.alias("at"), F.lit(amount).alias("change"))

    if include_in_flight:
        # Leaves when deleted, or when dead after the last allowed receive.
        dead_at = F.when(last_allowed & deleted_at.isNull(), hidden_until)
        per_receive = [change(F.coalesce(deleted_at, dead_at), -1)]
    else:
        deleted_late = F.when(deleted_at >= hidden_until, deleted_at)
        per_receive = [change(received, -1), change(shown_at, 1), change(deleted_late, -1)]

    arrivals = sends.select("queue", F.col("sent_at").alias("at"), F.lit(1).alias("change"))
    moves = (
        ack_join(
            receives.select("queue", "message_id", "receive_count", "receipt_handle", "received_at"),
            acks,
            rows_per_task,
        )
        .select("queue", F.explode(F.array(*per_receive)).alias("c"))
        .select("queue", "c.at", "c.change")
        .filter(F.col("at").isNotNull())
    )
    changes = arrivals.unionByName(moves).select(
        "queue", tick_at_or_after(F.col("at"), tick_s).alias("tick"), "change"
    )
    return step_series(changes, start, end, rows_per_task=rows_per_task)


def dead_letter_gauge(
    dead: DataFrame, tick_s: int, start: int, end: int, kept_s: int
) -> DataFrame:
    """Visible dead letters per queue at every tick; (queue, tick, visible).

    ``kept_s`` is how long a dead letter stays before it is removed.
    """
    changes = dead.select(
        "queue",
        F.explode(
            F.array(
                F.struct(tick_at_or_after(F.col("dead_at"), tick_s).alias("tick"), F.lit(1).alias("change")),
                F.struct(
                    tick_at_or_after(plus_seconds(F.col("dead_at"), kept_s), tick_s).alias("tick"),
                    F.lit(-1).alias("change"),
                ),
            )
        ).alias("c"),
    ).select("queue", "c.tick", "c.change")
    return step_series(changes, start, end, "visible")
