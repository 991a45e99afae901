"""Generated test messages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.functions.bodies import ENTRY_ID, message_body
from queuelens.functions.scalars import int_div

# Number of messages and entries per batch when not given.
COUNT = 10
BATCH_SIZE = 10


def generate_messages(
    spark: SparkSession,
    ts: str,
    count: int = COUNT,
    batch_size: int = BATCH_SIZE,
    prefix: str = "demo-message",
) -> DataFrame:
    """Messages 1 to ``count`` with entry id, batch and body; one time for all.

    Rows are made by the tasks; nothing is built on the driver.
    """
    n = F.col("n")
    batch = int_div(n - 1, batch_size) + 1
    return (
        spark.range(1, count + 1)
        .withColumnRenamed("id", "n")
        .withColumn("batch", batch)
        .select(
            "n",
            "batch",
            F.format_string(ENTRY_ID, n).alias("entry_id"),
            message_body(n, F.col("batch"), F.lit(ts), F.lit(count), prefix).alias("body"),
        )
    )
