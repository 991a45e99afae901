"""Structured log: records of a processed message, level threshold, log query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.schemas import LOG_RECORD

# Rank of each level name, and the level used for unknown names.
LEVEL_RANK = {
    "CRITICAL": 50,
    "FATAL": 50,
    "ERROR": 40,
    "WARNING": 30,
    "WARN": 30,
    "INFO": 20,
    "DEBUG": 10,
    "NOTSET": 0,
}
DEFAULT_LEVEL = "INFO"

# Message texts of the consumer's log records.
STARTED = "Processing message"
RECEIVED = "Received message: "
SUCCEEDED = "Message processed successfully"
FAILED = "Message processing failed"
DELETED = "Message deleted from queue"
DELETE_FAILED = "Failed to delete message — it will reappear after VisibilityTimeout"
KEPT = "Message not deleted — will retry or go to DLQ"
NOTHING_RECEIVED = "No messages received (queue may be empty)"
POLL_FAILED = "SQS API error during receive"
UNEXPECTED = "Unexpected error in polling loop"


def log_threshold(df: DataFrame, level: str = DEFAULT_LEVEL) -> DataFrame:
    """Keep records at or above ``level``; unknown names count as INFO."""
    default = LEVEL_RANK[DEFAULT_LEVEL]
    least = LEVEL_RANK.get(level.upper(), default)
    name = F.coalesce(F.upper("levelname"), F.lit(DEFAULT_LEVEL))
    if default >= least:
        too_low = [n for n, rank in LEVEL_RANK.items() if rank < least]
        return df.filter(~name.isin(too_low)) if too_low else df
    return df.filter(name.isin([n for n, rank in LEVEL_RANK.items() if rank >= least]))


def log_query(df: DataFrame, level: str = "ERROR", limit: int | None = None) -> DataFrame:
    """Time, message, id and duration of the records of one level, newest first."""
    found = (
        df.filter(F.col("levelname") == level)
        .select("asctime", "message", "message_id", "duration_ms")
        .orderBy(F.desc("asctime"), "message_id")
    )
    return found if limit is None else found.limit(limit)


def _record(levelname: Column, message: Column, **extras: Column) -> Column:
    """One log record without time and name; fields it does not carry are NULL."""
    values = {"levelname": levelname, "message": message, **extras}
    return F.struct(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_RECORD
            if f.name not in ("asctime", "name")
        ]
    )


def message_log(df: DataFrame, at: Column, duration_ms: Column, name: str = "queue") -> DataFrame:
    """The four log records a consumer writes for each processed message.

    ``df`` comes out of ``process_messages``. Where it has a column ``delete_error`` (text of
    the error, NULL if the delete worked), a success that could not be deleted is logged as
    such, with ``delete_error_code`` if there is that column.
    """
    ok = F.col("outcome.success")
    none = F.lit(None).cast("string")
    undeleted = F.col("delete_error") if "delete_error" in df.columns else none
    code = F.col("delete_error_code") if "delete_error_code" in df.columns else none
    lost = ok & undeleted.isNotNull()
    message_id = F.col("message_id")

    def only_if_failed(value):
        return F.when(~ok, value)

    started = _record(
        F.lit("INFO"),
        F.lit(STARTED),
        message_id=message_id,
        receive_count=F.col("receive_count"),
        body_length=F.col("body_length"),
    )
    received = _record(
        F.lit("INFO"), F.concat(F.lit(RECEIVED), "body"), message_id=message_id, body=F.col("body")
    )
    finished = _record(
        F.when(ok, "INFO").otherwise("ERROR"),
        F.when(ok, SUCCEEDED).otherwise(FAILED),
        message_id=message_id,
        receive_count=only_if_failed(F.col("receive_count")),
        duration_ms=duration_ms,
        error=only_if_failed(F.col("outcome.error")),
        error_type=only_if_failed(F.col("outcome.error_type")),
        exc_info=only_if_failed(F.col("outcome.exc_info")),
    )
    settled = _record(
        F.when(lost, "ERROR").when(ok, "DEBUG").otherwise("WARNING"),
        F.when(lost, DELETE_FAILED).when(ok, DELETED).otherwise(KEPT),
        message_id=message_id,
        error=F.when(lost, undeleted),
        error_code=F.when(lost, code),
    )
    records = F.explode(F.array(started, received, finished, settled))
    return (
        df.select(at.cast("timestamp_ntz").alias("asctime"), records.alias("r"))
        .select("asctime", F.lit(name).alias("name"), "r.*")
        .select(*LOG_RECORD.names)
    )


def poll_log(streaks: DataFrame, name: str = "queue") -> DataFrame:
    """The log records of polls that brought nothing or failed.

    ``streaks`` comes out of ``empty_poll_streak`` and may have columns ``error_code``,
    ``error``, ``error_type`` and ``exc_info``. Kind ``unexpected`` is any other error of the loop.
    """
    empty, unexpected = F.col("kind") == "empty", F.col("kind") == "unexpected"
    shown = {"error_code": ~empty & ~unexpected, "error": ~empty, "error_type": unexpected, "exc_info": unexpected}
    extras = {c: F.when(where, F.col(c)) for c, where in shown.items() if c in streaks.columns}
    record = _record(
        F.when(empty, "DEBUG").otherwise("ERROR"),
        F.when(empty, NOTHING_RECEIVED).when(unexpected, UNEXPECTED).otherwise(POLL_FAILED),
        empty_poll_count=F.when(empty, F.col("streak")),
        **extras,
    )
    return (
        streaks.filter(F.col("kind").isin("empty", "api_error", "unexpected"))
        .select(F.col("polled_at").alias("asctime"), F.lit(name).alias("name"), record.alias("r"))
        .select("asctime", "name", "r.*")
        .select(*LOG_RECORD.names)
    )
