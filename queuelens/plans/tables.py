"""Log tables derived from the given tables, without reading anything else.

The events table spans 30 days, so settings of seconds would never overlap;
every duration is 60 times the one in ``Policy``. See FIXTURES.md for the rules.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.functions.handlers import outcome
from queuelens.functions.scalars import duration_ms, int_div, plus_seconds, tick_at_or_after
from queuelens.operators.messages import RECEIVE_COUNT
from queuelens.operators.scaling import Policy
from queuelens.schemas import POLICY

SCALE = 60
VISIBILITY_S = 30 * SCALE
TICK_S = 15 * SCALE
ALARM_PERIOD = "1 hour"
DEAD_LETTERS_KEPT_S = 6 * 3600

AS_OF = "2024-01-14 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id() -> Column:
    return F.col("event_id")


def _ok_at() -> Column:
    """Number of the receive that succeeds; NULL if none does."""
    return (
        F.when(_id() % 50 == 13, F.lit(None).cast("int"))
        .when(_id() % 10 < 7, 1)
        .when(_id() % 10 < 9, 2)
        .otherwise(3)
    )


def _work_ms() -> Column:
    return (100 + _id() % 400).cast("int")


def sends(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("queue"),
        _id().alias("message_id"),
        F.col("ts").alias("sent_at"),
        F.col("props").alias("body"),
    )


def _deliveries(spark, sf_dir) -> DataFrame:
    delay = (_id() * 7919) % (1 + 60 * (F.dayofmonth("ts") % 5))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "event_type", "ts", _ok_at().alias("ok_at"), delay.alias("delay_min"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.coalesce("ok_at", F.lit(3)))))
        .select(
            F.col("event_type").alias("queue"),
            F.col("event_id").alias("message_id"),
            F.col("k").alias("receive_count"),
            F.concat_ws("-", F.lit("r"), "event_id", "k").alias("receipt_handle"),
            F.timestamp_add("MINUTE", F.col("delay_min") + 30 * (F.col("k") - 1), F.col("ts")).alias(
                "received_at"
            ),
            F.coalesce(F.col("k") == F.col("ok_at"), F.lit(False)).alias("success"),
            _work_ms().alias("work_ms"),
            F.col("ts").alias("sent_at"),
        )
    )


def receives(spark, sf_dir) -> DataFrame:
    return _deliveries(spark, sf_dir).select(
        "queue", "message_id", "receive_count", "receipt_handle", "received_at"
    )


def receives_with_outcome(spark, sf_dir) -> DataFrame:
    return _deliveries(spark, sf_dir).drop("work_ms", "sent_at")


def _acked_at() -> Column:
    """When a delivery is acknowledged: on success, or too late for some first receives; else NULL."""
    too_late = (F.col("receive_count") == 1) & (F.col("message_id") % 100 == 57)
    return F.when(F.col("success"), F.timestamp_add("MILLISECOND", F.col("work_ms"), F.col("received_at"))).when(
        too_late, F.timestamp_add("MINUTE", F.lit(31), F.col("received_at"))
    )


def acks(spark, sf_dir) -> DataFrame:
    """Acks of the succeeding receives, and late ones of some first receives."""
    found = _deliveries(spark, sf_dir).withColumn("acked_at", _acked_at())
    return found.filter(F.col("acked_at").isNotNull()).select("queue", "message_id", "receipt_handle", "acked_at")


def grid(spark, sf_dir) -> tuple[int, int]:
    """First and last tick of all logs: from the first send to where the last receive or ack has taken effect. One pass."""
    hidden_until = plus_seconds(F.max("received_at"), VISIBILITY_S)
    last = F.greatest(F.max("sent_at"), hidden_until, F.max(_acked_at()))
    ticks = _deliveries(spark, sf_dir).agg(
        tick_at_or_after(F.min("sent_at"), TICK_S).alias("first"), tick_at_or_after(last, TICK_S).alias("last")
    ).first()
    return (ticks["first"], ticks["last"]) if ticks["first"] is not None else (0, 0)


def polls(spark, sf_dir) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "error", "api_error")
        .when(F.col("event_type").isin("view", "click"), "empty")
        .otherwise("got")
    )
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("consumer"), F.col("ts").alias("polled_at"), kind.alias("kind"), "event_id")
        .withColumn("n_messages", F.when(F.col("kind") == "got", 1 + _id() % 10).otherwise(0))
        .drop("event_id")
    )


def log_records(spark, sf_dir) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARNING")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("asctime"),
        F.lit("queue").alias("name"),
        level.alias("levelname"),
        F.col("props").alias("message"),
        _id().cast("string").alias("message_id"),
        (int_div(_work_ms() * 1000 + 5, 10) / F.lit(100.0)).alias("duration_ms"),
    )


def envelopes(spark, sf_dir) -> DataFrame:
    """Envelopes with gaps and bad counts, next to the event they stand for."""
    count = (
        F.when(_id() % 43 == 0, "x").when(_id() % 47 == 0, F.lit(None).cast("string")).otherwise("1")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("queue"),
        F.when(_id() % 41 != 0, _id().cast("string")).alias("message_id"),
        F.concat_ws("-", F.lit("r"), "event_id", F.lit("1")).alias("receipt_handle"),
        F.when(_id() % 53 != 0, F.col("props")).alias("body"),
        F.when(count.isNull(), F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit(RECEIVE_COUNT), count))
        .alias("attributes"),
    )


def fails_on_error_queue(message: Column) -> Column:
    """Handler: messages of the queue ``error`` fail."""
    return outcome(message["queue"] != "error", "cannot handle error events", "ValueError")


def fails_on_error_queue_python(message: dict) -> None:
    if message["queue"] == "error":
        raise ValueError("cannot handle error events")


def processing_times(df: DataFrame) -> DataFrame:
    """Adds ``started_at`` and ``finished_at`` of a message."""
    return df.withColumns(
        {"started_at": F.col("ts"), "finished_at": F.timestamp_add("MILLISECOND", _work_ms(), F.col("ts"))}
    )


def work_duration() -> Column:
    return duration_ms(F.col("ts"), F.timestamp_add("MILLISECOND", _work_ms(), F.col("ts")))


def send_results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.when(_id() % 91 != 0, int_div(_id(), 10) + 1).alias("batch"),
        F.concat_ws("-", F.lit("msg"), "event_id").alias("entry_id"),
        F.when(_id() % 37 == 0, "failed").otherwise("sent").alias("status"),
    )


def versions(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    tag = (
        F.when(key % 4 == 0, F.concat(F.lit("v"), key))
        .when(key % 4 == 1, F.concat(F.lit("sha-"), key))
        .when(key % 4 == 2, F.concat(F.lit("tmp-"), key))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo"),
        key.alias("id"),
        F.col("o_orderdate").alias("pushed_at"),
        tag.alias("tag"),
    )


def policies(spark) -> tuple[DataFrame, DataFrame]:
    """Base policy per environment, and the overlay of ``dev``."""
    base = spark.createDataFrame([(env, *Policy()) for env in ("dev", "prod")], POLICY)
    overlay = spark.createDataFrame([("dev", 0, 3, 10, 15, None, None, None)], POLICY)
    return base, overlay


def address_blocks(spark, sf_dir) -> DataFrame:
    """A block for every customer; some are no blocks."""
    key = F.col("c_custkey")
    octets = F.concat_ws(".", F.lit(10) + key % 3, key % 5, (key * 7) % 256, (key * 31) % 256)
    prefix = F.when(key % 50 == 0, F.lit(8)).otherwise(18 + key % 15)
    block = F.concat_ws("/", octets, prefix)
    text = F.when(key % 41 == 0, octets).when(key % 43 == 0, F.concat(F.lit("300."), block)).otherwise(block)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("block"))


def allowed_ranges(spark, sf_dir) -> DataFrame:
    """Ranges by supplier, of one address to many thousand, not aligned to blocks."""
    key = F.col("s_suppkey").cast("bigint")
    low = F.lit(10 * 2**24).cast("bigint") + (key * 7_919_993) % (3 * 2**24)
    return table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + (key * key * 37) % 200_000).alias("high"))
