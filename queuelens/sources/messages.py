"""Reading stored envelopes, in batch and as a bounded stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from queuelens.schemas import ENVELOPE, LOG_RECORD

# Fixed value: units per poll by default.
MAX_PER_POLL = 1

# Fixed value: longest wait for data of one poll; the trigger interval of an
# unbounded run.
WAIT = "20 seconds"


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = ENVELOPE
) -> DataFrame:
    """Stored envelopes. No rows is a normal result."""
    return spark.read.schema(schema).format(fmt).load(path)


def stream_messages(
    spark: SparkSession,
    path: str,
    max_per_trigger: int | None = MAX_PER_POLL,
    fmt: str = "parquet",
    schema: StructType = ENVELOPE,
) -> DataFrame:
    """Stored envelopes as a stream of at most ``max_per_trigger`` files per poll.

    The bound is on files, not rows; on a large source allow as many files as the
    cluster reads at once. ``None`` takes all files that are there as one micro-batch. Polls
    that find nothing are normal.
    """
    if max_per_trigger is not None and max_per_trigger < 1:
        raise ValueError(f"max_per_trigger must be at least 1, got {max_per_trigger}")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.load(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records written by ``write_log``."""
    return (
        spark.read.schema(LOG_RECORD).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
    )
