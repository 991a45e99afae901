"""Retry decisions with state per message.

State is a small table written with each micro-batch: the failures in a row of the
messages that are neither done nor dead. A micro-batch reads the state before it, puts
the receives of each message in order and decides with windows over both.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from queuelens.operators.messages import MAX_RECEIVE_COUNT
from queuelens.operators.retention import MESSAGE_RETENTION

DECISION = "queue string, message_id bigint, receipt_handle string, received_at timestamp_ntz, receive_count int, route string"
STATE = "queue string, message_id bigint, received_at timestamp_ntz, receipt_handle string, failures int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*spark.createDataFrame([], schema).columns)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def decide(rows: DataFrame, state: DataFrame, max_receive_count: int, ttl_s: int) -> tuple[DataFrame, DataFrame]:
    """Decisions for the failed receives in ``rows``, and the state after them.

    Receives of a message count in the order of ``received_at, receipt_handle``. Failures
    in a row are numbered; number ``max_receive_count`` is dead and the count starts anew, as it
    does after a success or after ``ttl_s`` without a receive.
    """
    kept = state.select(*[F.col(c) for c in ("queue", "message_id", "received_at", "receipt_handle")], F.lit(False).alias("success"), F.col("failures").alias("weight"))
    new = rows.select("queue", "message_id", "received_at", "receipt_handle", "success", F.when(F.col("success"), 0).otherwise(1).alias("weight"))
    both = kept.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    in_order = W.partitionBy("queue", "message_id").orderBy("new", "received_at", "receipt_handle")
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    gap = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.lag("received_at").over(in_order).cast("timestamp"))
    starts = F.coalesce(F.lag("success").over(in_order) | (gap > ttl_s * 1_000_000), F.lit(False))
    numbered = (
        both.withColumn("starts", starts.cast("int"))
        .withColumn("run", F.sum("starts").over(so_far))
        .withColumn("number", F.sum("weight").over(W.partitionBy("queue", "message_id", "run").orderBy("new", "received_at", "receipt_handle").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("last", F.lead("new").over(in_order).isNull())
    )
    count = (F.pmod(F.col("number") - 1, F.lit(max_receive_count)) + 1).cast("int")
    decided = numbered.filter(F.col("new") & ~F.col("success")).select(
        "queue",
        "message_id",
        "receipt_handle",
        "received_at",
        count.alias("receive_count"),
        F.when(count == max_receive_count, "dead").otherwise("retry").alias("route"),
    )
    after = (
        numbered.filter(F.col("last") & ~F.col("success"))
        .select("queue", "message_id", "received_at", "receipt_handle", F.pmod("number", F.lit(max_receive_count)).cast("int").alias("failures"))
        .filter("failures > 0")
    )
    return decided, after


def retry_sink(
    path: str, max_receive_count: int = MAX_RECEIVE_COUNT, ttl_s: int = MESSAGE_RETENTION
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: decides on the failed receives of a micro-batch.

    Layout ``path/decisions/batch_id=N`` and ``path/state/batch_id=N``, the state after the
    batch. A replayed batch reads the state before it again and replaces its own folders
    only. State of a message goes with its success or death, and once it is older than
    ``ttl_s`` against the latest receive seen.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _read(spark, f"{path}/state/batch_id={batch_id - 1}", STATE)
        decided, after = decide(batch, state, max_receive_count, ttl_s)
        decided.write.mode("overwrite").parquet(f"{path}/decisions/batch_id={batch_id}")
        latest = after.agg(F.max("received_at").alias("latest"))
        fresh = F.col("received_at") >= F.timestamp_add("SECOND", F.lit(-ttl_s), F.col("latest"))
        after.crossJoin(F.broadcast(latest)).filter(fresh).drop("latest").write.mode("overwrite").parquet(  # one row
            f"{path}/state/batch_id={batch_id}"
        )

    return write


def retry_state(
    stream: DataFrame, path: str, max_receive_count: int = MAX_RECEIVE_COUNT, ttl_s: int = MESSAGE_RETENTION
) -> StreamingQuery:
    """Per failed receive (column ``success`` false): deliver again, or dead.

    Starts a query over the available data that writes below ``path``; ``read_decisions``
    reads the result. How receives fall into micro-batches does not matter as long as
    those of a message come in order from one micro-batch to the next.
    """
    sink = retry_sink(path, max_receive_count, ttl_s)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/decisions", DECISION)
