"""The consumer: receive, process, then acknowledge, retry or dead-letter."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from queuelens.functions.handlers import Handler
from queuelens.operators.messages import (
    MAX_RECEIVE_COUNT,
    normalize_messages,
    process_messages,
    route_outcomes,
)
from queuelens.session import configure
from queuelens.sources.messages import WAIT, stream_messages
from queuelens.sources.sinks import delete_sink, read_routed, read_settled, route_sink
from queuelens.streaming.running import drained

# Files per micro-batch, for all executors together.
FILES_PER_BATCH = 1_000


def consume(
    spark: SparkSession,
    src: str,
    sink: str,
    handler: Handler,
    available_now: bool = True,
    max_per_trigger: int = FILES_PER_BATCH,
    max_receive_count: int = MAX_RECEIVE_COUNT,
    deleter: Handler | None = None,
) -> StreamingQuery:
    """One streaming query from the envelopes in ``src`` to the routes below ``sink``.

    A micro-batch is acknowledged by its commit in ``sink/checkpoint``: whatever
    was not committed is delivered again, and then replaces what it wrote. The
    query drains ``src`` and stops, or polls until stopped.

    With ``deleter`` (a handler that gives DELETION) acknowledged messages are deleted in a second step of
    each micro-batch, whose outcomes are ``sink/deletions``.
    """
    configure(spark)
    received = normalize_messages(stream_messages(spark, src, max_per_trigger))
    routed = route_outcomes(process_messages(received, handler), max_receive_count)
    writer = (
        routed.writeStream.foreachBatch(
            route_sink(f"{sink}/messages") if deleter is None else delete_sink(sink, deleter, max_receive_count)
        )
        .option("checkpointLocation", f"{sink}/checkpoint")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=WAIT)
    return writer.start()


def consume_rounds(
    spark: SparkSession,
    src: str,
    sink: str,
    handler: Handler,
    max_per_trigger: int = FILES_PER_BATCH,
    max_receive_count: int = MAX_RECEIVE_COUNT,
    idle_s: float | None = None,
    deleter: Handler | None = None,
) -> DataFrame:
    """Consume ``src`` and every message that has to be delivered again.

    A file stream reads each file once, so failed messages come back by rounds:
    round k reads what round k-1 wrote for retry, under a checkpoint of its own.
    A round starts after the one before has committed; a replay inside a round
    therefore never changes files another round reads. Receive counts rise from
    round to round, so the rounds end: with the one that leaves nothing to retry.
    Calling again picks up new files only.

    With ``deleter`` a message that was processed but could not be deleted is delivered again like a
    failed one, its receive count raised.

    A round may take any time; with ``idle_s`` it ends in an error after so long without progress.

    Returns all final rows (``route`` ack or dead).
    """
    finals, source, k = [], src, 0
    while source:
        k += 1
        place = f"{sink}/round={k}"
        query = consume(
            spark,
            source,
            place,
            handler,
            max_per_trigger=max_per_trigger,
            max_receive_count=max_receive_count,
            deleter=deleter,
        )
        drained(query, idle_s)
        routed = read_routed(spark, f"{place}/messages") if deleter is None else read_settled(spark, place)
        finals.append(routed.filter("route <> 'retry'"))
        done = routed.filter("route = 'retry'").isEmpty()
        source = None if done else f"{place}/{'messages' if deleter is None else '*'}/batch_id=*/route=retry"
    return reduce(DataFrame.unionByName, finals)
