"""Keep the first delivery of each message."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from queuelens.operators.lifecycle import MESSAGE
from queuelens.streaming.store import BatchStore

FIRSTS = "message_id bigint, queue string, bucket bigint, first struct<received_at:timestamp_ntz,receipt_handle:string>, last timestamp_ntz"


def _thinned(rows: DataFrame, within_s: int) -> DataFrame:
    """Earliest delivery and latest time per message and bucket of time.

    Deliveries of one bucket are never further apart than the delay. The aggregation is
    partial first, so a message in a flood leaves each task as a row per bucket.
    """
    bucket = F.expr(f"unix_micros(cast(received_at as timestamp)) div {within_s * 1_000_000}")
    return (
        rows.groupBy(*MESSAGE, bucket.alias("bucket"))
        .agg(F.min(F.struct("received_at", "receipt_handle")).alias("first"), F.max("received_at").alias("last"))
    )


def dedup_messages(stream: DataFrame, path: str, within_s: int) -> StreamingQuery:
    """Writes below ``path`` what ``first_deliveries`` needs, from all data available now.

    A micro-batch is thinned to a row per message and bucket of time; a replayed one
    replaces its own folder, and those of earlier ones are put together. There is no state to keep and no order to rely on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = _store(batch.sparkSession, path)
        store.write(_thinned(batch, within_s), batch_id)
        store.compact(before=batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def first_deliveries(spark: SparkSession, path: str, within_s: int) -> DataFrame:
    """queue, message_id, received_at, receipt_handle: the first delivery of every message.

    Deliveries that follow another within the delay repeat it, whatever micro-batch they
    came in. One that comes later than that is a first delivery again. First means the least
    (``received_at``, ``receipt_handle``).
    """
    buckets = _joined(_store(spark, path).read())
    before = W.partitionBy(*MESSAGE).orderBy("bucket")
    since = F.unix_micros(F.col("first.received_at").cast("timestamp")) - F.unix_micros(F.lag("last").over(before).cast("timestamp"))
    new = buckets.withColumn("new", F.coalesce(since > within_s * 1_000_000, F.lit(True)))
    return new.filter("new").select("queue", "message_id", "first.received_at", "first.receipt_handle")


def _joined(rows: DataFrame) -> DataFrame:
    """One row per message and bucket out of those of several micro-batches."""
    found = rows.groupBy(*MESSAGE, "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("batch_id").alias("batch_id"))
    return found.select(*MESSAGE, "bucket", "first", "last", "batch_id")


def _store(spark: SparkSession, path: str) -> BatchStore:
    return BatchStore(spark, f"{path}/firsts", FIRSTS, _joined)
