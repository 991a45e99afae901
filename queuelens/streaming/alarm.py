"""Dead-letter alarm on a stream of gauge samples."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from queuelens.operators.alarm import PERIOD, THRESHOLD, alarm_rows
from queuelens.streaming.store import BatchStore

ALARM = "queue string, window_start timestamp_ntz, window_end timestamp_ntz, total bigint, alarm boolean"


def dlq_alarm_stream(
    samples: DataFrame, path: str, period: str = PERIOD, threshold: int = THRESHOLD, lateness: str = "0 seconds"
) -> StreamingQuery:
    """The alarm per period, written below ``path`` each time a period's sum has changed.

    Sums are state until the watermark passes the period, so samples later than
    ``lateness`` are dropped. ``read_alarms`` gives the latest row of each period, also of
    those the watermark has not passed. A replayed micro-batch replaces its own folder; those of earlier ones are
    put together.
    """
    timed = samples.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        store = _store(batch.sparkSession, path)
        store.write(batch, batch_id)
        store.compact(before=batch_id)

    writer = alarm_rows(timed, F.col("at"), period, threshold).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    """The alarm of every period: of its rows the one of the latest micro-batch."""
    return _latest(_store(spark, path).read()).drop("batch_id")


def _latest(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("queue", "window_start", "window_end").agg(F.max(F.struct("batch_id", "total", "alarm")).alias("r"))
    return found.select("queue", "window_start", "window_end", "r.total", "r.alarm", "r.batch_id")


def _store(spark: SparkSession, path: str) -> BatchStore:
    return BatchStore(spark, f"{path}/alarms", ALARM, _latest)
