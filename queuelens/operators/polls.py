"""What consumers saw when they polled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK


def poll_profile(polls: DataFrame) -> DataFrame:
    """Per hour and consumer: polls, empty polls, API errors, messages."""
    return polls.groupBy(F.date_trunc("hour", "polled_at").cast("timestamp_ntz").alias("hour"), "consumer").agg(
        F.count("*").alias("polls"),
        F.count_if(F.col("kind") == "empty").alias("empty_polls"),
        F.count_if(F.col("kind") == "api_error").alias("api_errors"),
        F.coalesce(F.sum("n_messages"), F.lit(0)).alias("messages"),
    )


def empty_poll_streak(polls: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Adds ``streak``: empty polls of the consumer since its last non-empty one.

    An API error leaves the count as it is. The streak is the number of empty
    polls so far minus that number at the last non-empty poll.
    """
    order = ["polled_at", "kind", "n_messages"]
    runs = Ordered(polls, ["consumer"], order, rows_per_task)
    runs.running_sum("_empty", F.when(F.col("kind") == "empty", 1).otherwise(0))
    runs.running_max("_before", F.when(F.col("kind") == "got", F.col("_empty")))
    streak = F.col("_empty") - F.coalesce("_before", F.lit(0))
    return runs.frame().withColumn("streak", streak.cast("bigint")).drop("_empty", "_before")
