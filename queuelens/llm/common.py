"""Helpers shared by the operators of this subpackage."""

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.session import stored

__all__ = ["chunks", "documents", "fits_broadcast", "fresh", "give_back", "lean", "least_places", "per_process", "stored", "table", "whole_text"]

#: Characters handed to the numeric code at once; a longer text is a chunk of its own.
CHUNK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(text: str = "text") -> Column:
    """The text column, null counted as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its other columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether a stored table of narrow rows is small enough to be sent to every task."""
    return df.count() <= max_rows


def least_places(df: DataFrame, place: str, rows: int, *ties: str) -> DataFrame:
    """The ``rows`` rows of ``df`` with the least ``place``, a 64-bit hash; ties by the columns named.

    A hash is as likely in one place as in another, so most rows can be left out before
    any are sorted: what reaches the driver does not grow with the number of tasks.
    """
    n = df.count()
    if n > 8 * rows:
        df = df.filter(F.col(place) < -(2**63) + 2**64 * 4 * rows // n)
    return df.orderBy(place, *ties).limit(rows)


def per_process(key: Any, build: Callable[[], Any]) -> Any:
    """``build()`` once per Python worker process; later tasks of the process share it."""
    kept = sys.modules.setdefault("_queuelens_llm_kept", types.ModuleType("_queuelens_llm_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def give_back() -> None:
    """Hand memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := per_process("malloc-trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None)):  # the C library of Linux has it
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, without what the worker keeps of memory freed before and by it.

    Worker processes live on from task to task; else each keeps as much as its largest task took.
    """

    def within(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return within


def chunks(texts: Iterable[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts with about ``most`` characters; null becomes empty."""
    run, size = [], 0
    for text in texts:
        text = text or ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run
