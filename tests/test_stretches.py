"""A stretch of time that is fed to a stream is one micro-batch however many files it has."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from queuelens.plans import queries
from queuelens.streaming.retry import STATE, decide, read_decisions, retry_state


def test_retry_over_stretches_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILES_PER_BATCH", 1, raising=False)  # the former limit
    start = datetime(2024, 1, 1)
    rows = [
        ("q", m, f"{m}-{k}", start + timedelta(minutes=k), (m + k) % 7 == 0) for m in range(20) for k in range(24)
    ]
    df = spark.createDataFrame(
        rows, "queue string, message_id bigint, receipt_handle string, received_at timestamp_ntz, success boolean"
    )
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = str(tmp_path / "out")
        queries._fed_in_order(spark, df, "received_at", lambda s: retry_state(s, out))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(list(Path(out, "decisions").glob("batch_id=*"))) == 3
    want, _ = decide(df, spark.createDataFrame([], STATE), 3, 10**6)
    got = read_decisions(spark, out)
    columns = [F.col(c) for c in ("queue", "message_id", "receipt_handle", "receive_count", "route")]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
