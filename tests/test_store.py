"""Stores of micro-batches: few files, replays, and crashes between a merge and its manifest."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from queuelens.session import scratch
from queuelens.streaming.store import BatchStore

SCHEMA = "key int, value int"


def rows_of(store, **how):
    return sorted((r["batch_id"], r["key"], r["value"]) for r in store.read(**how).collect())


def put(spark, store, batch_id, value=None):
    store.write(spark.createDataFrame([(batch_id % 3, batch_id if value is None else value)], SCHEMA).coalesce(1), batch_id)


def test_a_thousand_micro_batches_are_tens_of_files(spark):
    """Files are copied in, as 1,000 Spark writes would take minutes; merges are those of the store."""
    path = scratch(spark, "store")
    store = BatchStore(spark, path, SCHEMA)
    put(spark, store, 0)
    (file,) = glob.glob(f"{path}/batches/batch_id=0/*.parquet")
    for batch_id in range(1, 1000):
        os.mkdir(f"{path}/batches/batch_id={batch_id}")
        shutil.copy(file, f"{path}/batches/batch_id={batch_id}/part-0.parquet")
    store.compact(before=1000)
    assert [r[0] for r in rows_of(store)] == list(range(1000))
    assert len(store.folders()) == 1 and store.folders()[0].startswith("merged/tier=3/")
    assert len(store.read().inputFiles()) == 1
    assert rows_of(store, before=5) == [(b, 0, 0) for b in range(5)]
    reading = store.read()
    store.vacuum(older_than_s=3600)  # nothing is that old: readers that have begun go on
    assert reading.count() == 1000
    store.vacuum(older_than_s=-1)
    assert len(glob.glob(f"{path}/batches/*")) == 0 and len(glob.glob(f"{path}/merged/*/*")) == 1
    assert len(rows_of(store)) == 1000


def test_tiers_and_replay(spark):
    path = scratch(spark, "store")
    store = BatchStore(spark, path, SCHEMA, fan=3)
    assert rows_of(store) == [] and store.folders() == []
    for batch_id in range(11):
        put(spark, store, batch_id)
        store.compact(before=batch_id)
    # Batch 10 may come again: it is in a folder of its own. So is 9, of which there are too few to merge.
    assert store.folders()[1:] == ["batches/batch_id=9", "batches/batch_id=10"] and "tier=2" in store.folders()[0]
    put(spark, store, 10, value=-1)
    store.compact(before=10)
    assert rows_of(store) == [*((b, b % 3, b) for b in range(10)), (10, 1, -1)]


def test_a_crash_before_the_manifest_changes_nothing(spark, monkeypatch):
    path = scratch(spark, "store")
    store = BatchStore(spark, path, SCHEMA, fan=2)
    for batch_id in range(4):
        put(spark, store, batch_id)
    before = rows_of(store)

    def crash(_):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "_publish", crash)
        store.compact(before=4)
    assert rows_of(store) == before and len(store.folders()) == 4
    assert len(glob.glob(f"{path}/merged/*/*")) == 1  # named by nobody
    store.compact(before=4)
    assert rows_of(store) == before and len(store.folders()) == 1
    store.vacuum(older_than_s=-1)
    assert rows_of(store) == before and len(glob.glob(f"{path}/merged/*/*")) == 1


def test_two_writers_do_not_overwrite_each_other(spark, monkeypatch):
    path = scratch(spark, "store")
    one, two = (BatchStore(spark, path, SCHEMA, fan=2) for _ in range(2))
    for batch_id in range(2):
        put(spark, one, batch_id)
    merge = two._merge

    def late(*how):
        found = merge(*how)
        versions = two._versions()
        one.compact(before=2)
        monkeypatch.setattr(two, "_versions", lambda: versions)
        return found

    monkeypatch.setattr(two, "_merge", late)
    with pytest.raises(RuntimeError, match="another writer"):
        two.compact(before=2)
    assert len(rows_of(one)) == 2


def test_reduced_merges(spark):
    def latest(rows):
        found = rows.groupBy("key").agg(F.max(F.struct("batch_id", "value")).alias("r"))
        return found.select("key", "r.value", "r.batch_id")

    store = BatchStore(spark, scratch(spark, "store"), SCHEMA, latest, fan=4)
    for batch_id in range(5):
        put(spark, store, batch_id)
    store.compact(before=5)
    assert rows_of(store) == [(1, 1, 1), (2, 2, 2), (3, 0, 3), (4, 1, 4)]
