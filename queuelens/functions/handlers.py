"""Message handlers: what happens to one message.

A handler is a function from a struct column (the message) to an OUTCOME column.
Native handlers stay in Spark expressions; ``python_handler`` wraps ordinary
Python for work that Spark cannot express.
"""

import traceback
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from queuelens.schemas import OUTCOME

Handler = Callable[[Column], Column]


def outcome(success: Column, error: Column | str, error_type: Column | str) -> Column:
    """OUTCOME of a native handler; error texts are kept only for failures.

    A condition that is NULL counts as failed.
    """
    failed = ~F.coalesce(success, F.lit(False))
    text = [F.lit(x) if isinstance(x, str) else x for x in (error, error_type)]
    return F.struct(
        (~failed).alias("success"),
        F.when(failed, text[0]).alias("error"),
        F.when(failed, text[1]).alias("error_type"),
        F.lit(None).cast("string").alias("exc_info"),
    )


def accept_all(message: Column) -> Column:
    """Handler that succeeds on every message."""
    return outcome(F.lit(True), "", "")


def _trace(problem: Exception, known: dict[tuple, str]) -> str:
    """The traceback as text. Its frames are formatted once for each place an exception comes from, in ``known``."""
    if problem.__cause__ or problem.__context__ or isinstance(problem, (SyntaxError, ExceptionGroup)) or hasattr(problem, "__notes__"):
        return "".join(traceback.format_exception(problem))
    places, at = [], problem.__traceback__
    while at:
        places.append((at.tb_frame.f_code, at.tb_lasti))
        at = at.tb_next
    frames = known.get(tuple(places))
    if frames is None:
        if len(known) >= 1_000:
            known.clear()
        frames = known[tuple(places)] = "".join(traceback.format_tb(problem.__traceback__))
    kind = type(problem)
    name = kind.__qualname__ if kind.__module__ in ("builtins", "__main__") else f"{kind.__module__}.{kind.__qualname__}"
    said = str(problem)
    return f"Traceback (most recent call last):\n{frames}{name}: {said}\n" if said else f"Traceback (most recent call last):\n{frames}{name}\n"


def python_handler(fn: Callable[[dict], object], columns: list[str] | None = None) -> Handler:
    """Run ``fn(message)`` per message in Arrow batches.

    The message is a dictionary of Python values: whole numbers stay whole, NULL is None,
    a map is a dictionary. Only ``columns`` are sent to Python if they are named. An
    exception marks that message as failed, with its traceback in ``exc_info``, and
    leaves the others alone.
    """
    names = OUTCOME.names

    @F.arrow_udf(OUTCOME)
    def run(messages: pa.Array) -> pa.Array:
        maps = [f.name for f in messages.type if pa.types.is_map(f.type)]
        rows, known = [], {}
        for message in messages.to_pylist():
            message |= {name: dict(message[name]) for name in maps if message[name] is not None}
            try:
                fn(message)
                rows.append((True, None, None, None))
            except Exception as problem:
                rows.append((False, str(problem), type(problem).__name__, _trace(problem, known)))
        kinds = [pa.bool_(), pa.string(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    if columns is None:
        return run
    return lambda message: run(F.struct(*[message[c].alias(c) for c in columns]))
