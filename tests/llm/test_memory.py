"""What worker processes hold: nothing of what a task has freed, and likelihoods of some contexts at a time."""

import re
import sys
import tracemalloc

import numpy as np
import pytest

from queuelens.llm import common, toxicity


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="asks the C library of Linux")
def test_a_task_leaves_no_freed_memory_behind():
    kept = []

    def run(batches):
        for batch in batches:
            parts = [np.ones(12_000) for _ in range(1000)]  # 96 MB in parts below the size that the system gets back by itself
            kept.append(np.ones(12_000))
            del parts
            yield batch

    common.give_back()
    before = held_mb()
    assert list(run(iter([1, 2]))) == [1, 2]
    plain = held_mb() - before
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert plain > 48 and held_mb() - before < 24


@pytest.fixture
def counted():
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 64**6, 300_000) << 2 | r.integers(0, 4, 300_000))
    counts = toxicity.Counts()
    counts.join(keys, r.integers(1, 9, len(keys)))
    cells, n = toxicity._continued(np.unique(keys >> 2), toxicity.SHORT)
    short = np.zeros(toxicity.SIGNS**toxicity.SHORT, np.uint8)
    short[cells] = n
    return counts, short, np.unique(np.concatenate((keys[::3] >> 2, r.integers(0, 64**6, 1000))))


@pytest.mark.parametrize("halves", [(0,), (1,), (0, 1)])
def test_likelihoods_of_some_contexts_at_a_time_are_the_same(monkeypatch, counted, halves):
    counts, short, asked = counted
    whole = counts.likelihoods(halves, short).ratio(asked)
    for held in (10_000, 10**9):
        monkeypatch.setattr(toxicity, "HELD_GRAMS", held)
        np.testing.assert_array_equal(counts.ratio(asked, halves, short, 1), whole)
    assert not len(toxicity.Counts().ratio(asked[:0], halves, short, 3))
    assert np.isfinite(toxicity.Counts().ratio(asked[:9], halves, short, 3)).all()


def test_likelihoods_take_bounded_memory(monkeypatch, counted):
    counts, short, asked = counted

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    whole = peak(lambda: counts.likelihoods((0, 1), short).ratio(asked))
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 30_000)
    assert peak(lambda: counts.ratio(asked, (0, 1), short, 1)) < whole / 2
