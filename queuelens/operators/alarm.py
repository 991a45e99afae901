"""Dead-letter alarm on tumbling windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The alarm goes off above this sum, over one period of this length.
THRESHOLD = 1
PERIOD = "60 seconds"


def alarm_rows(samples: DataFrame, ts: Column, period: str, threshold: int) -> DataFrame:
    return (
        samples.groupBy("queue", F.window(ts, period).alias("w"))
        .agg(F.sum("visible").alias("total"))
        .select(
            "queue",
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "total",
            (F.col("total") > threshold).alias("alarm"),
        )
    )


def dlq_alarm(samples: DataFrame, period: str = PERIOD, threshold: int = THRESHOLD) -> DataFrame:
    """Sum of the gauge (queue, ts, visible) per period; alarm when above the threshold."""
    return alarm_rows(samples, F.col("ts"), period, threshold)
