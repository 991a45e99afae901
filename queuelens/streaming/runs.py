"""Retry decisions that do not depend on how, or in what order, receives fall into micro-batches.

Time is cut into stretches. Receives of a message within one are summed up as a run summary: its ends,
whether a break lies in it, and its failures since the last one. A break is a success, or
a gap longer than the time to live. Summaries merge, so what a stretch carries into the next ones follows from
summaries alone, and a late receive is put in its place: its stretch is decided again, and
those later ones whose carry changes, up to the next break. Each micro-batch writes the decisions it
changes; of several for a receive the latest micro-batch counts.

A huge message is a few summaries; within a stretch its receives are ordered over many tasks.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from queuelens.functions.scalars import epoch_micros, int_div
from queuelens.operators.messages import MAX_RECEIVE_COUNT
from queuelens.operators.ordered import Ordered
from queuelens.operators.retention import MESSAGE_RETENTION
from queuelens.operators.skew import ROWS_PER_TASK, hot_groups
from queuelens.session import stored
from queuelens.streaming.store import BatchStore

#: Length of a stretch of time.
STRETCH_S = 86_400

MESSAGE = ["message_id", "queue"]
PLACE = [*MESSAGE, "stretch"]
IN_ORDER = ["received_at", "receipt_handle"]
DECIDED = ["queue", "message_id", "receipt_handle", "received_at"]
RECEIVE = "message_id bigint, queue string, receipt_handle string, received_at timestamp_ntz, success boolean, stretch bigint"
SUMMARY = (
    "message_id bigint, queue string, stretch bigint, first_at timestamp_ntz, last_at timestamp_ntz, "
    "broken boolean, tail bigint"
)
DECISION = "queue string, message_id bigint, receipt_handle string, received_at timestamp_ntz, receive_count int, route string"


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows of a key that of the latest micro-batch."""
    others = [c for c in rows.columns if c not in [*key, "batch_id"]]
    found = rows.groupBy(*key).agg(F.max_by(F.struct("batch_id", *others), "batch_id").alias("r"))
    return found.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def _stores(spark: SparkSession, path: str) -> tuple[BatchStore, BatchStore, BatchStore]:
    """Receives, summaries and decisions."""
    return (
        BatchStore(spark, f"{path}/receives", RECEIVE),
        BatchStore(spark, f"{path}/summaries", SUMMARY, lambda rows: _newest(rows, PLACE)),
        BatchStore(spark, f"{path}/decisions", DECISION, lambda rows: _newest(rows, DECIDED)),
    )


def _gap(later: Column, earlier: Column, ttl_s: int) -> Column:
    return F.coalesce(epoch_micros(later) - epoch_micros(earlier) > ttl_s * 1_000_000, F.lit(False))


def numbered(receives: DataFrame, ttl_s: int, rows_per_task: int | None) -> DataFrame:
    """Adds ``run`` (breaks before the receive within its stretch) and ``number`` (failures of the run so far)."""
    breaks = F.coalesce(F.col("_before.success") | _gap(F.col("received_at"), F.col("_before.received_at"), ttl_s), F.lit(False))
    by_stretch = (
        Ordered(receives, PLACE, IN_ORDER, rows_per_task)
        .previous("_before", F.struct("success", "received_at"))
        .frame()
        .withColumn("_breaks", breaks.cast("bigint"))
    )
    with_run = Ordered(by_stretch, PLACE, IN_ORDER, rows_per_task).running_sum("run", F.col("_breaks")).frame()
    failed = F.when(F.col("success"), 0).otherwise(1)
    return (
        Ordered(with_run, [*PLACE, "run"], IN_ORDER, rows_per_task)
        .running_sum("number", failed)
        .frame()
        .drop("_before", "_breaks")
    )


def summaries(rows: DataFrame) -> DataFrame:
    """One summary per message and stretch, from ``numbered`` rows. A success is the last of its run, so the last run ends in the greatest row."""
    last = F.max(F.struct("run", "number", "success"))
    return (
        rows.groupBy(*PLACE)
        .agg(
            F.min("received_at").alias("first_at"),
            F.max("received_at").alias("last_at"),
            last.alias("_last"),
        )
        .select(
            *PLACE,
            "first_at",
            "last_at",
            ((F.col("_last.run") > 0) | F.col("_last.success")).alias("broken"),
            F.when(F.col("_last.success"), 0).otherwise(F.col("_last.number")).cast("bigint").alias("tail"),
        )
    )


def carries(found: DataFrame, ttl_s: int, rows_per_task: int | None) -> DataFrame:
    """message, stretch, carry: the failures in a row with which each stretch is entered."""
    before = Ordered(found, MESSAGE, ["stretch"], rows_per_task).previous("_last_at", F.col("last_at")).frame()
    gap = _gap(F.col("first_at"), F.col("_last_at"), ttl_s)
    marked = before.withColumn("_gap", gap).withColumn("_anew", (F.col("broken") | F.col("_gap")).cast("bigint"))
    in_runs = Ordered(marked, MESSAGE, ["stretch"], rows_per_task).running_sum("_run", F.col("_anew")).frame()
    # What a stretch leaves behind: its tail since its last break, or all of its failures on top of what came in.
    left = Ordered(in_runs, [*MESSAGE, "_run"], ["stretch"], rows_per_task).running_sum("_left", F.col("tail")).frame()
    entered = Ordered(left, MESSAGE, ["stretch"], rows_per_task).previous("_in", F.col("_left")).frame()
    carry = F.when(F.col("_gap"), F.lit(0)).otherwise(F.coalesce("_in", F.lit(0))).cast("bigint")
    return entered.select(*PLACE, carry.alias("carry"))


def retry_sink(
    path: str,
    max_receive_count: int = MAX_RECEIVE_COUNT,
    ttl_s: int = MESSAGE_RETENTION,
    stretch_s: int = STRETCH_S,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: decides on failed receives, and again on those that new ones put in another light.

    Layout ``path/receives``, ``path/summaries`` and ``path/decisions``, a ``BatchStore`` each. A replayed
    micro-batch reads what the ones before have left and replaces its own folders only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stretch = int_div(epoch_micros(F.col("received_at")), stretch_s * 1_000_000).alias("stretch")
        receives, found, decisions = _stores(spark, path)
        receives.write(
            batch.select(*MESSAGE, *reversed(IN_ORDER), F.coalesce("success", F.lit(False)).alias("success"), stretch), batch_id
        )
        known = receives.read(before=batch_id + 1)
        new = known.filter(F.col("batch_id") == batch_id)
        known = known.drop("batch_id")
        touched = new.select(*PLACE).distinct()

        # One look for huge messages; without any, plain windows do.
        limit = rows_per_task if hot_groups(known, MESSAGE, rows_per_task) else None
        there = known.join(touched, PLACE, "left_semi")
        there = stored(there, "receives") if limit else there  # several passes then
        again = stored(numbered(there, ttl_s, limit), "numbered")
        found.write(summaries(again), batch_id)

        # Carries before and after, of the messages in question. One within a single stretch carries nothing.
        of = found.read(before=batch_id + 1)
        long = of.groupBy(*MESSAGE).agg(F.min("stretch").alias("first"), F.max("stretch").alias("last")).filter("first < last")
        long = stored(long.select(*MESSAGE).join(touched.select(*MESSAGE).distinct(), MESSAGE, "left_semi"), "long")
        of = of.join(long, MESSAGE, "left_semi")
        after = stored(carries(_newest(of, PLACE), ttl_s, limit), "carries")
        before = carries(_newest(of.filter(F.col("batch_id") < batch_id), PLACE), ttl_s, limit)
        old = before.withColumnRenamed("carry", "_carry")
        shifted = after.join(old, PLACE).filter("carry <> _carry").select(*PLACE).join(touched, PLACE, "left_anti")
        shifted = stored(shifted, "shifted")
        if not shifted.isEmpty():
            # Only the run a stretch begins with takes anything over.
            more = numbered(known.join(shifted, PLACE, "left_semi"), ttl_s, rows_per_task)  # other stretches: looked at anew
            again = again.unionByName(more.filter("run = 0"))
        failed = again.filter(~F.col("success")).join(after, PLACE, "left")
        total = F.col("number") + F.when(F.col("run") == 0, F.coalesce("carry", F.lit(0))).otherwise(0)
        count = (F.pmod(total - 1, F.lit(max_receive_count)) + 1).cast("int")
        route = F.when(count == max_receive_count, "dead").otherwise("retry").alias("route")
        decisions.write(failed.select(*DECIDED, count.alias("receive_count"), route), batch_id)
        for store in (receives, found, decisions):
            store.compact(before=batch_id)

    return write


def retry_in_any_order(
    stream: DataFrame,
    path: str,
    max_receive_count: int = MAX_RECEIVE_COUNT,
    ttl_s: int = MESSAGE_RETENTION,
    stretch_s: int = STRETCH_S,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> StreamingQuery:
    """Per failed receive (column ``success`` false or null): deliver again, or dead.

    Failures in a row are numbered in the order of ``received_at, receipt_handle``; number ``max_receive_count``
    is dead and the count starts anew, as it does after a success or after ``ttl_s`` without a receive. The
    answer is the same for every split and order of micro-batches. A receipt handle is unique within its message.

    Starts a query over the available data that writes below ``path``; ``latest_decisions`` reads the result.
    """
    sink = retry_sink(path, max_receive_count, ttl_s, stretch_s, rows_per_task)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def latest_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision on every failed receive, corrections counted in."""
    return _newest(_stores(spark, path)[2].read(), DECIDED).drop("batch_id")
