"""Writing: structured log lines, and the outcome of consumed messages."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from queuelens.functions.handlers import Handler
from queuelens.operators.messages import DELETION, MAX_RECEIVE_COUNT, RECEIVE_COUNT, settle_deletions
from queuelens.schemas import DELIVERY

# Fixed value: time format of log lines.
LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss"

ROUTES = ("ack", "retry", "dead")


def log_lines(df: DataFrame) -> DataFrame:
    """One flat JSON object per record; fields that are NULL are left out."""
    fields = [
        F.date_format("asctime", LOG_TIME).alias("asctime") if name == "asctime" else F.col(name)
        for name in df.columns
    ]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_log(df: DataFrame, path: str) -> None:
    log_lines(df).write.mode("append").text(path)


def _write_routes(batch: DataFrame, names: list[str], folder: str) -> None:
    again = F.map_concat(
        F.map_filter(
            F.coalesce("attributes", F.create_map().cast("map<string,string>")),
            lambda name, _: name != RECEIVE_COUNT,
        ),
        F.create_map(F.lit(RECEIVE_COUNT), (F.col("receive_count") + 1).cast("string")),
    )
    attributes = F.when(F.col("route") == "retry", again).otherwise(F.col("attributes"))
    batch.withColumn("attributes", attributes).select(*names, "route").write.mode("overwrite").partitionBy("route").parquet(folder)


def route_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: writes routed messages below ``path``.

    Layout ``path/batch_id=N/route=ack|retry|dead``. All three routes of a batch
    come from one pass over it and are committed together, so a message never
    lands in two of them. A replayed batch replaces its own folder and nothing
    else. Messages to retry are written as they will be delivered next: with
    their receive count raised by one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_routes(batch, DELIVERY.names, f"{path}/batch_id={batch_id}")

    return write


def delete_sink(
    path: str, deleter: Handler, max_receive_count: int = MAX_RECEIVE_COUNT
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: ``route_sink``, then the deletion of what was acknowledged.

    The second step reads what the first has written, so no handler runs twice, and writes its own outcomes to
    ``path/deletions/batch_id=N/route=...``: the last word on every message of route ``ack`` in ``path/messages``.
    Each step replaces its own folder of the micro-batch, so both can be repeated, together or the second alone.
    """
    first = route_sink(f"{path}/messages")

    def write(batch: DataFrame, batch_id: int) -> None:
        first(batch, batch_id)
        delete_acknowledged(batch.sparkSession, path, batch_id, deleter, max_receive_count)

    return write


def delete_acknowledged(
    spark: SparkSession, path: str, batch_id: int, deleter: Handler, max_receive_count: int = MAX_RECEIVE_COUNT
) -> None:
    """The second step of ``delete_sink`` for one micro-batch that the first has written."""
    acknowledged = read_routed(spark, f"{path}/messages/batch_id={batch_id}").filter("route = 'ack'")
    settled = settle_deletions(acknowledged, deleter, max_receive_count)
    _write_routes(settled, [*DELIVERY.names, "deletion"], f"{path}/deletions/batch_id={batch_id}")


def read_deletions(spark: SparkSession, path: str) -> DataFrame:
    """Outcome log of the deletions, one row per acknowledged delivery: its message, ``deletion`` and final ``route``."""
    schema = StructType([*DELIVERY.fields, StructField("deletion", StructType.fromDDL(DELETION)), StructField("route", StringType())])
    return _read(spark, f"{path}/deletions", schema)


def read_settled(spark: SparkSession, path: str) -> DataFrame:
    """All deliveries with their final route: those never acknowledged, and the outcome of each deletion."""
    others = read_routed(spark, f"{path}/messages").filter("route <> 'ack'")
    return others.unionByName(read_deletions(spark, path).drop("deletion"))


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """All messages written by ``route_sink``; a filter on ``route`` prunes folders.

    A consumer that has received nothing so far has written nothing: no rows.
    """
    return _read(spark, path, StructType([*DELIVERY.fields, StructField("route", StringType())]))


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
