"""Accounting of sent batches, batch assignment, processing outcomes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.scalars import desired_replicas, int_div
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK


def send_summary(results: DataFrame) -> DataFrame:
    """Accepted and rejected entries per batch, and in total (``is_total``).

    Entries without a batch are a group of their own, with ``batch`` NULL too.
    """
    per_batch = results.groupBy("batch").agg(
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return per_batch.rollup("batch").agg(
        F.sum("sent").alias("sent"),
        F.sum("failed").alias("failed"),
        F.count("*").alias("batches"),
        (F.grouping("batch") == 1).alias("is_total"),
    )


def predict_replicas(results: DataFrame, queue_length: int = 5, max_replicas: int = 5) -> DataFrame:
    """One row: entries sent and rejected, and the workers the sent ones will call for."""
    return results.agg(
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("replicas", desired_replicas(F.col("sent"), queue_length, 0, max_replicas))


def assign_batches(
    df: DataFrame, n: int, key: list[str], order: list[str], rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``batch``: per key, rows in order are cut into batches of ``n``."""
    numbered = Ordered(df, key, order, rows_per_task).row_number("_row").frame()
    return numbered.withColumn("batch", int_div(F.col("_row") - 1, n) + 1).drop("_row")


def outcome_summary(df: DataFrame) -> DataFrame:
    """Per queue: processed, failed, average and longest duration.

    Durations have two decimals; they are added up as whole hundredths, so the
    average does not depend on the order in which rows arrive.
    """
    hundredths = F.round(F.col("duration_ms") * 100).cast("bigint")
    return (
        df.groupBy("queue")
        .agg(
            F.count_if("outcome.success").alias("processed"),
            F.count_if(~F.col("outcome.success")).alias("failed"),
            F.sum(hundredths).alias("total"),
            F.count(hundredths).alias("timed"),
            F.max(hundredths).alias("longest"),
        )
        .select(
            "queue",
            "processed",
            "failed",
            F.try_divide(F.col("total"), F.col("timed") * 100).alias("avg_duration_ms"),
            (F.col("longest") / 100).alias("max_duration_ms"),
        )
    )
