"""Column to Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def plus_seconds(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def tick_at_or_after(ts: Column, tick_s: int) -> Column:
    """Number of the first sampling tick at or after ``ts``."""
    step = tick_s * 1_000_000
    return int_div(epoch_micros(ts) + F.lit(step - 1), step)


def tick_time(tick: Column, tick_s: int) -> Column:
    return F.timestamp_micros(tick.cast("bigint") * F.lit(tick_s * 1_000_000)).cast("timestamp_ntz")


def desired_replicas(
    depth: Column,
    queue_length: Column | int = 5,
    min_replicas: Column | int = 0,
    max_replicas: Column | int = 5,
) -> Column:
    """Backlog divided by the backlog per worker, rounded up and clamped."""
    def as_column(value):
        return F.lit(value) if isinstance(value, int) else value

    per_worker = as_column(queue_length).cast("bigint")
    wanted = int_div(depth + per_worker - 1, per_worker)
    return F.least(
        F.greatest(wanted, as_column(min_replicas).cast("bigint")),
        as_column(max_replicas).cast("bigint"),
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds with two decimals, rounded half up on whole microseconds."""
    micros = epoch_micros(end) - epoch_micros(start)
    return int_div(micros + 5, 10) / F.lit(100.0)


def queue_name(name: Column, project: Column, environment: Column) -> Column:
    """The given name, or ``<project>-<environment>-queue`` when it is blank."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return F.when(blank, F.concat_ws("-", project, environment, F.lit("queue"))).otherwise(name)


def dead_letter_name(queue: Column) -> Column:
    return F.concat(queue, F.lit("-dlq"))


def fingerprint(*columns: str) -> Column:
    """Hash of a row's content: of its fields as a JSON object, in the order given.

    Quoting keeps values apart whatever they contain, and NULL is written without quotes.
    """
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    return F.md5(F.to_json(fields, {"ignoreNullFields": "false"}))
