"""Explicit schemas of the log tables. Nothing is inferred from data."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


ENVELOPE = _schema(
    message_id=StringType(),
    receipt_handle=StringType(),
    body=StringType(),
    attributes=MapType(StringType(), StringType()),
)

# ``exc_info`` is the traceback of a handler written in Python.
OUTCOME = _schema(
    success=BooleanType(), error=StringType(), error_type=StringType(), exc_info=StringType()
)

# What the consumer keeps per delivery: the envelope to send again, the count
# it was delivered with, and what became of it.
DELIVERY = StructType(ENVELOPE.fields + _schema(receive_count=IntegerType(), outcome=OUTCOME).fields)

SEND_LOG = _schema(
    queue=StringType(), message_id=LongType(), sent_at=TimestampNTZType(), body=StringType()
)

RECEIVE_LOG = _schema(
    queue=StringType(),
    message_id=LongType(),
    receive_count=IntegerType(),
    receipt_handle=StringType(),
    received_at=TimestampNTZType(),
)

ACK_LOG = _schema(
    queue=StringType(),
    message_id=LongType(),
    receipt_handle=StringType(),
    acked_at=TimestampNTZType(),
)

POLL_LOG = _schema(
    consumer=LongType(), polled_at=TimestampNTZType(), kind=StringType(), n_messages=LongType()
)

GAUGE = _schema(queue=StringType(), ts=TimestampNTZType(), visible=LongType())

POLICY = _schema(
    env=StringType(),
    min_replicas=IntegerType(),
    max_replicas=IntegerType(),
    poll_s=IntegerType(),
    cooldown_s=IntegerType(),
    stabilization_s=IntegerType(),
    queue_length=IntegerType(),
    in_flight=BooleanType(),
)

LOG_RECORD = _schema(
    asctime=TimestampNTZType(),
    name=StringType(),
    levelname=StringType(),
    message=StringType(),
    message_id=StringType(),
    receive_count=IntegerType(),
    body_length=IntegerType(),
    body=StringType(),
    duration_ms=DoubleType(),
    error=StringType(),
    error_type=StringType(),
    exc_info=StringType(),
    error_code=StringType(),
    empty_poll_count=LongType(),
)

SEND_RESULT = _schema(batch=LongType(), entry_id=StringType(), status=StringType())

VERSION = _schema(
    repo=StringType(), id=LongType(), pushed_at=TimestampNTZType(), tag=StringType()
)
