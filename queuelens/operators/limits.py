"""Limits on how fast a number of workers may change, as a parallel scan.

What a tick does depends on the number of workers before it, so ticks seem to need one pass
in order. But a tick is a function from the few possible recent numbers to the next ones,
a table of fixed size, and such tables compose. Blocks of ticks compose theirs to one
table each, blocks of blocks again; from the top down every block then learns how it
is entered. One group spreads over as many tasks as it has blocks, and no task needs more than a block.
"""

import json
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.scalars import int_div
from queuelens.session import is_small, stored

#: Ticks in a block, and blocks in a block above.
FAN = 64
#: Most entries of the table of a tick: (workers + 1) to the power of the ticks a limit looks back.
MOST_STATES = 4_096


class RateLimit(NamedTuple):
    """At most ``value`` pods, or per cent of the workers at its start, in a period."""

    kind: str
    value: int
    period_s: int


# Five workers more in 15 s, all of them less in 30 s.
SCALE_UP = [RateLimit("pods", 5, 15)]
SCALE_DOWN = [RateLimit("percent", 100, 30)]


def _bound(limit: RateLimit, at_start: int, sign: int) -> int:
    if limit.kind == "pods":
        return at_start + sign * limit.value
    # Rounded so that a growing number may grow, and a falling one may fall.
    return -(-at_start * (100 + limit.value) // 100) if sign > 0 else at_start * (100 - limit.value) // 100


def transitions(up: list[RateLimit], down: list[RateLimit], tick_s: int, most: int) -> list[list[int]]:
    """By wanted number, and last by none: the state after each state.

    A state holds the numbers at the last ticks, the latest as the lowest digit to the base ``most`` + 1.
    """
    for limit in [*up, *down]:
        if limit.kind not in ("pods", "percent") or limit.value < 0 or limit.period_s <= 0:
            raise ValueError(f"no such limit: {limit}")
    back = {limit: max(1, ceil(limit.period_s / tick_s)) for limit in [*up, *down]}
    digits = max(back.values(), default=1)
    base = most + 1
    if base**digits > MOST_STATES:
        raise ValueError(f"{most} workers over {digits} ticks are more than {MOST_STATES} states; sample less often or limit shorter periods")
    table = []
    for wanted in [*range(base), None]:
        row = []
        for state in range(base**digits):
            past = [state // base**k % base for k in range(digits)]
            now = past[0]
            highest = max([_bound(x, past[back[x] - 1], 1) for x in up], default=most)
            lowest = min([_bound(x, past[back[x] - 1], -1) for x in down], default=0)
            goal = now if wanted is None else wanted
            after = min(goal, max(highest, now)) if goal > now else max(goal, min(lowest, now))
            row.append(after + state * base % base**digits)
        table.append(row)
    return table


def limit_changes(
    series: DataFrame,
    tick_s: int,
    up: list[RateLimit] = SCALE_UP,
    down: list[RateLimit] = SCALE_DOWN,
    most: int = 5,
    start: int = 0,
    wanted: str = "replicas",
    key: str = "queue",
    tick: str = "tick",
    into: str = "limited",
) -> DataFrame:
    """``series`` with ``into``: the workers there are if ``wanted`` is followed as fast as the limits allow.

    A period reaches back to the tick that lies ``period_s`` before (rounded up to whole ticks), and a limit counts from the
    workers there were at that tick. Of several limits the one that allows most holds; without limits a
    direction is free. Before its first tick a group has had ``start`` workers for ever. ``wanted`` beyond
    0 to ``most`` is cut to it; NULL changes nothing. One row per (key, tick); rows without a tick take no part.
    """
    table = transitions(up, down, tick_s, most)
    base, n = most + 1, len(table[0])
    known = F.from_json(F.lit(json.dumps(table)), "array<array<int>>")  # folded into one constant
    opening = sum(start * base**k for k in range(n) if base**k < n)

    def after(state: Column, row: Column) -> Column:
        cut = F.least(F.greatest(row[wanted].cast("int"), F.lit(0)), F.lit(most))
        goal = F.when(row[wanted].isNull(), F.lit(base)).otherwise(cut)
        return F.get(F.get(known, goal), state)

    def states(entry: Column, items: str, step) -> Column:
        """The state before each item, and after the last."""
        return F.aggregate(items, F.array(entry), lambda seen, x: F.concat(seen, F.array(step(F.element_at(seen, -1), x))))

    names = [c for c in series.columns if c != tick]
    rows = F.array_sort(F.collect_list(F.struct(tick, *names)))
    identity = F.sequence(F.lit(0), F.lit(n - 1))
    # Every row travels once, in its block; upper levels have one table per block.
    blocks = stored(
        series.filter(F.col(tick).isNotNull())
        .groupBy(F.col(key).alias("_key"), int_div(F.col(tick), FAN).alias("_block"))
        .agg(rows.alias("_rows"))
        .withColumn("_table", F.aggregate("_rows", identity, lambda f, x: F.transform(f, lambda s: after(s, x)))),
        "limited",
    )
    low, high = blocks.agg(F.min("_block"), F.max("_block")).first()
    count = high - low + 1 if low is not None else 1
    blocks = blocks.withColumn("_block", F.col("_block") - F.lit(low or 0))
    levels = [blocks.select("_key", "_block", "_table")]
    groups = []
    while True:
        group = (
            levels[-1]
            .groupBy("_key", int_div(F.col("_block"), FAN).alias("_above"))
            .agg(F.array_sort(F.collect_list(F.struct("_block", "_table"))).alias("_items"))
        )
        groups.append(group)
        count = (count - 1) // FAN + 1
        if count == 1:
            break
        composed = F.aggregate("_items", identity, lambda f, x: F.transform(f, lambda s: F.get(x["_table"], s)))
        levels.append(stored(group.select("_key", F.col("_above").alias("_block"), composed.alias("_table")), "limited"))

    entered = groups[-1].withColumn("_entry", F.lit(opening))
    for group in [*reversed(groups[:-1]), None]:
        before = states(F.col("_entry"), "_items", lambda state, x: F.get(x["_table"], state))
        pairs = F.zip_with("_items", before, lambda x, s: F.struct(x["_block"].alias("_block"), s.alias("_entry")))
        below = entered.select("_key", F.explode(F.filter(pairs, lambda p: p["_block"].isNotNull())).alias("_p"))
        below = below.select(F.col("_key").alias("_k"), F.col("_p._block").alias("_b"), F.col("_p._entry").alias("_entry"))
        below = below if len(groups) == 1 else stored(below, "limited")
        lower = blocks if group is None else group.withColumnRenamed("_above", "_block")
        few = F.broadcast(below) if is_small(below) else below
        entered = lower.join(few, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")
    after_each = F.slice(states(F.col("_entry"), "_rows", after), F.lit(2), F.size("_rows"))
    limited = F.zip_with("_rows", after_each, lambda x, s: F.struct(x.alias("row"), (s % base).cast("bigint").alias(into)))
    out = entered.select(F.explode(limited).alias("_r"))
    return out.select(*[F.col(f"_r.row.{c}").alias(c) for c in series.columns], F.col(f"_r.{into}").alias(into))
