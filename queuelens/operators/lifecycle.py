"""Life of a message: deliveries, acknowledgements, state, dead letters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.functions.scalars import dead_letter_name, plus_seconds
from queuelens.operators.messages import MAX_RECEIVE_COUNT
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK, hot_groups, in_groups, join_unique
from queuelens.session import is_small

# The id comes first: sorts compare the first column first, and ids tell rows
# apart where a handful of queue names do not.
MESSAGE = ["message_id", "queue"]
DELIVERY = [*MESSAGE, "receipt_handle"]
#: Exhausted receives (about 100 bytes each) up to which their handles go to every task.
EXHAUSTED_ROWS = 200_000
IN_TIME_ORDER = ["received_at", "receipt_handle"]


def attempt_number(receives: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Adds ``attempt``: the how-manieth receive of its message this is."""
    return Ordered(receives, MESSAGE, IN_TIME_ORDER, rows_per_task).row_number("attempt").frame()


def ack_join(receives: DataFrame, acks: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Each receive with its acknowledgement, if any.

    Adds ``acked_at`` (first ack of that receipt handle), ``next_received_at``
    and ``stale_ack``: the message was received again before the ack came, so
    the ack deleted nothing.

    Receives and acks are brought together by message in one shuffle, which
    serves both the match by handle and the look at the next receive. Messages
    with very many deliveries go another way: join by handle, then segments.
    """
    acks = acks.dropna(subset=DELIVERY)
    both = receives.select(*MESSAGE).unionByName(acks.select(*MESSAGE))
    hot = hot_groups(both, MESSAGE, rows_per_task)
    few_receives, few_acks = receives, acks
    if hot:
        few_receives = receives.filter(~in_groups(MESSAGE, hot))
        few_acks = acks.filter(~in_groups(MESSAGE, hot))
    matched = _match_by_message(few_receives, few_acks)
    if hot:
        first_ack = (
            acks.filter(in_groups(MESSAGE, hot)).groupBy(*DELIVERY).agg(F.min("acked_at").alias("acked_at"))
        )
        many = receives.filter(in_groups(MESSAGE, hot))
        many = join_unique(many, first_ack, DELIVERY, "left", rows_per_task)
        many = Ordered(many, MESSAGE, IN_TIME_ORDER, rows_per_task, hot)
        matched = matched.unionByName(many.following("next_received_at", F.col("received_at")).frame())
    stale = F.col("acked_at").isNotNull() & F.coalesce(
        F.col("next_received_at") <= F.col("acked_at"), F.lit(False)
    )
    return matched.withColumn("stale_ack", stale)


def _match_by_message(receives: DataFrame, acks: DataFrame) -> DataFrame:
    log = receives.withColumn("_receive", F.lit(True)).unionByName(
        acks.select(*DELIVERY, F.col("acked_at").alias("_acked_at"), F.lit(False).alias("_receive")),
        allowMissingColumns=True,
    )
    by_delivery = W.partitionBy(*DELIVERY)
    # Acks sort after all receives of the message, so the next row of a receive
    # is the next receive or an ack, which has no received_at.
    in_order = W.partitionBy(*MESSAGE).orderBy(F.desc("_receive"), *IN_TIME_ORDER)
    # The wider window comes first: its shuffle by message also serves the other.
    return (
        log.withColumn("_next", F.lead("received_at").over(in_order))
        .withColumn("acked_at", F.min("_acked_at").over(by_delivery))
        .withColumnRenamed("_next", "next_received_at")
        .filter("_receive")
        .drop("_receive", "_acked_at")
    )


def valid_acks(joined: DataFrame) -> DataFrame:
    """Receives out of ``ack_join`` whose acknowledgement deleted the message."""
    return joined.filter(F.col("acked_at").isNotNull() & ~F.col("stale_ack"))


def pending_messages(
    sends: DataFrame, acked: DataFrame, rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Sent messages that no valid acknowledgement removed.

    ``acked`` holds receives with a valid ack. Its keys are reduced to one row
    each on the way to the join, so a message acknowledged often stays small.
    """
    return join_unique(sends, acked.select(*MESSAGE).distinct(), MESSAGE, "left_anti", rows_per_task)


def message_state(
    sends: DataFrame,
    receives: DataFrame,
    acks: DataFrame,
    as_of: str,
    visibility_s: int,
    max_receive_count: int = MAX_RECEIVE_COUNT,
) -> DataFrame:
    """State of every message sent by ``as_of``, from what was logged by then.

    VISIBLE until received; IN_FLIGHT for ``visibility_s`` after a receive or
    until acknowledged; then DELETED if acknowledged, DEAD if it was the last
    allowed receive, VISIBLE again otherwise. Intervals include their start.

    Only two reductions, both with partial aggregation: deliveries with their
    ack, then messages. No task ever holds all rows of a message.
    """
    moment = F.lit(as_of).cast("timestamp_ntz")
    received = receives.filter(F.col("received_at") <= moment)
    acked = acks.filter(F.col("acked_at") <= moment)
    sent = sends.filter(F.col("sent_at") <= moment).select(*MESSAGE, "sent_at")
    settled = _settled(received, acked, visibility_s, max_receive_count)
    messages = (
        sent.unionByName(settled, allowMissingColumns=True)
        .groupBy(*MESSAGE)
        .agg(F.min("sent_at").alias("sent_at"), *_last_delivery())
        .filter(F.col("sent_at").isNotNull())
    )
    ends = plus_seconds(F.col("last_received_at"), visibility_s)
    state = (
        F.when(F.col("last_received_at").isNull(), "VISIBLE")
        .when(F.col("last_settled_at") == F.col("last_received_at"), "DELETED")
        .when(moment < ends, "IN_FLIGHT")
        .when(F.col("receive_count") >= max_receive_count, "DEAD")
        .otherwise("VISIBLE")
    )
    receive_count = F.coalesce("receive_count", F.lit(0))
    return messages.withColumn("state", state).select(
        *MESSAGE,
        "sent_at",
        "last_received_at",
        receive_count.alias("receive_count"),
        "state",
        (receive_count > 1).alias("redelivered"),
        F.when(F.col("state") == "IN_FLIGHT", ends).alias("visible_again_at"),
    )


def _last_delivery() -> list[Column]:
    """Last delivery of a message, and the last one acknowledged in time: the
    message is gone when they are the same. Plain numbers and times only, so the
    reduction stays a hash aggregation."""
    return [
        F.max("received_at").alias("last_received_at"),
        F.max("settled_at").alias("last_settled_at"),
        F.max("receive_count").alias("receive_count"),
    ]


def _settled(
    receives: DataFrame, acks: DataFrame, visibility_s: int, max_receive_count: int
) -> DataFrame:
    """One row per receipt handle; ``settled_at`` repeats ``received_at`` when its
    ack came, and came before a message at its last receive had moved away."""
    ends = plus_seconds(F.col("received_at"), visibility_s)
    in_time = F.col("acked_at").isNotNull() & (
        (F.col("receive_count") < max_receive_count) | (F.col("acked_at") < ends)
    )
    return (
        receives.select(*DELIVERY, "received_at", "receive_count")
        .unionByName(acks.dropna(subset=DELIVERY).select(*DELIVERY, "acked_at"), allowMissingColumns=True)
        .groupBy(*DELIVERY)
        .agg(
            F.max("received_at").alias("received_at"),
            F.max("receive_count").alias("receive_count"),
            F.min("acked_at").alias("acked_at"),
        )
        .filter(F.col("received_at").isNotNull())
        .select(
            *MESSAGE,
            "received_at",
            "receive_count",
            F.when(in_time, F.col("received_at")).alias("settled_at"),
        )
    )


def queue_depth(states: DataFrame) -> DataFrame:
    """Messages per queue and state; input from ``message_state``."""
    def count_of(state):
        return F.count_if(F.col("state") == state)

    return states.groupBy("queue").agg(
        count_of("VISIBLE").alias("visible"),
        count_of("IN_FLIGHT").alias("in_flight"),
        count_of("DELETED").alias("deleted"),
        count_of("DEAD").alias("dead"),
    )


def retry_profile(receives: DataFrame) -> DataFrame:
    """Number of messages by their highest receive count."""
    return (
        receives.groupBy(*MESSAGE)
        .agg(F.max("receive_count").alias("receive_count"))
        .groupBy("receive_count")
        .agg(F.count("*").alias("messages"))
    )


def dead_letters(
    receives: DataFrame,
    acks: DataFrame,
    visibility_s: int,
    max_receive_count: int = MAX_RECEIVE_COUNT,
) -> DataFrame:
    """Messages whose last allowed receive was not acknowledged in time.

    Of the receives only those that reached the limit are shuffled, and of the acks, as
    long as those receives are few, only theirs. An ack that comes after the message has
    moved is too late.
    """
    exhausted = receives.filter(F.col("receive_count") >= max_receive_count)
    handles = exhausted.select(*DELIVERY)
    if is_small(handles, EXHAUSTED_ROWS):
        acks = acks.join(F.broadcast(handles.distinct()), DELIVERY, "left_semi")
    settled = _settled(exhausted, acks, visibility_s, max_receive_count)
    last = settled.groupBy(*MESSAGE).agg(*_last_delivery())
    never_settled = F.coalesce(F.col("last_settled_at") < F.col("last_received_at"), F.lit(True))
    return last.filter(never_settled).select(
        *MESSAGE,
        dead_letter_name(F.col("queue")).alias("dead_letter_queue"),
        "receive_count",
        "last_received_at",
        plus_seconds(F.col("last_received_at"), visibility_s).alias("dead_at"),
    )
