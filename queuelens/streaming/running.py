"""Running streaming queries to their end."""

from pyspark.sql.streaming import StreamingQuery


def drained(query: StreamingQuery, idle_s: float | None = None) -> StreamingQuery:
    """Wait for a query that stops by itself, however long it works.

    With ``idle_s`` a query is stopped, and an error raised, once it has made no progress
    for that time: no micro-batch has ended since. That should be more than the
    longest micro-batch takes.
    """
    seen = None
    try:
        if idle_s is None:
            query.awaitTermination()
            return query
        while not query.awaitTermination(idle_s):
            progress = query.lastProgress
            now = (progress["runId"], progress["batchId"], progress["timestamp"]) if progress and progress["numInputRows"] else seen
            if now == seen:
                raise TimeoutError(f"streaming query has made no progress for {idle_s} s")
            seen = now
    except BaseException:
        query.stop()
        raise
    return query
