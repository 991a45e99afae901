"""Row-level message operators: normalise, process, route, size, duration, parse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.bodies import TIME_FORMAT, body_field
from queuelens.functions.handlers import Handler
from queuelens.functions.scalars import duration_ms

# Defaults of a missing envelope field, and the attribute that
# carries the number of deliveries so far.
UNKNOWN_ID = "unknown"
RECEIVE_COUNT = "ApproximateReceiveCount"

# Redrive limit and body size limit of the queue service.
MAX_RECEIVE_COUNT = 3
BODY_LIMIT = 262_144


def normalize_messages(df: DataFrame) -> DataFrame:
    """Fill in missing envelope fields and read the receive count as a number.

    A count that is not a number becomes 1 and sets ``bad_receive_count``; the
    row and its neighbours stay. ``body_length`` counts characters.
    """
    text = F.col("attributes")[RECEIVE_COUNT]
    count = text.try_cast("int")
    body = F.coalesce("body", F.lit(""))
    return df.withColumns(
        {
            "message_id": F.coalesce("message_id", F.lit(UNKNOWN_ID)),
            "receipt_handle": F.coalesce("receipt_handle", F.lit("")),
            "body": body,
            "receive_count": F.coalesce(count, F.lit(1)),
            "bad_receive_count": text.isNotNull() & count.isNull(),
            "body_length": F.length(body),
        }
    )


def process_messages(df: DataFrame, handler: Handler) -> DataFrame:
    """Run ``handler`` on every message; adds ``outcome``.

    The handler sees all columns, message attributes too. One failing message is one
    failed outcome, never a failed job.
    """
    return df.withColumn("outcome", handler(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def route_outcomes(df: DataFrame, max_receive_count: int = MAX_RECEIVE_COUNT) -> DataFrame:
    """Adds ``route``: acknowledge, deliver again, or move to the dead letters."""
    return df.withColumn(
        "route",
        F.when(F.col("outcome.success"), "ack")
        .when(F.col("receive_count") < max_receive_count, "retry")
        .otherwise("dead"),
    )


def body_size(df: DataFrame, column: str = "body", limit: int = BODY_LIMIT) -> DataFrame:
    """Adds characters, UTF-8 bytes, and whether the bytes exceed ``limit``."""
    size = F.octet_length(column)
    return df.withColumns(
        {"n_characters": F.length(column), "n_bytes": size, "too_large": size > limit}
    )


def processing_duration(df: DataFrame, start: str, end: str) -> DataFrame:
    """Adds ``duration_ms`` with two decimals."""
    return df.withColumn("duration_ms", duration_ms(F.col(start), F.col(end)))


def parse_body(df: DataFrame, column: str = "body") -> DataFrame:
    """Adds the fields of a generated body: n, batch, ts, total; NULL if it is none."""
    def field(group: int) -> Column:
        return body_field(F.col(column), group)

    return df.withColumns(
        {
            "n": field(1).try_cast("bigint"),
            "batch": field(2).try_cast("bigint"),
            "ts": F.try_to_timestamp(field(3), F.lit(TIME_FORMAT)).cast("timestamp_ntz"),
            "total": field(4).try_cast("bigint"),
        }
    )


#: Outcome of deleting an acknowledged message.
DELETION = "deleted boolean, error string, error_code string"


def deletion(done: Column, error: Column | str, error_code: Column | str) -> Column:
    """DELETION of a native deleter; error texts are kept only where it failed. A condition that is NULL counts as failed."""
    failed = ~F.coalesce(done, F.lit(False))
    text = [F.lit(x) if isinstance(x, str) else x for x in (error, error_code)]
    return F.struct(
        (~failed).alias("deleted"), F.when(failed, text[0]).alias("error"), F.when(failed, text[1]).alias("error_code")
    )


def settle_deletions(df: DataFrame, deleter: Handler, max_receive_count: int = MAX_RECEIVE_COUNT) -> DataFrame:
    """Deletes messages of route ``ack``; adds ``deletion`` and changes ``route`` where that failed.

    A message whose deletion fails was processed, yet it comes back: to be delivered again, or to
    the dead letters if this was its last allowed delivery. Other routes are left as they are.
    """
    done = F.col("route") == "ack"
    found = df.withColumn("deletion", F.when(done, deleter(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    again = F.when(F.col("receive_count") < max_receive_count, "retry").otherwise("dead")
    return found.withColumn("route", F.when(done & ~F.col("deletion.deleted"), again).otherwise(F.col("route")))
