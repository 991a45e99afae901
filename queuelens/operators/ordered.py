"""Running values within ordered groups, also when one group is huge.

A plain window puts each group into one task. That is the right plan for small
groups and the wrong one for a group that holds a good part of the table. Here
the few huge groups are found first (see ``skew``). Their rows are range-partitioned on (group, order), so one group spreads over many tasks;
each task works on its own stretch ("segment") and takes over a carry from the
segments before it. All other groups keep the plain window. Both ways give the
same rows, so the sketch only decides speed, never the result.
"""

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from queuelens.operators.skew import ROWS_PER_TASK, hot_groups, in_groups
from queuelens.session import stored

_SEGMENT = "_segment"
_POSITION = "_position"
_SO_FAR = (W.unboundedPreceding, W.currentRow)


class Ordered:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` (ascending).

    Each method adds one column; ``frame()`` returns all rows. ``order`` should
    tell rows of a group apart. A caller that knows the huge groups already, and
    has kept only their rows, passes them as ``hot``.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        rows_per_task: int | None = ROWS_PER_TASK,
        hot: dict[int, int] | None = None,
    ):
        self.keys, self.order = keys, order
        self.cold, self.hot = (df, None) if hot is None else (None, df)
        if hot is None:
            hot = hot_groups(df, keys, rows_per_task)
            if hot:
                self.cold, self.hot = df.filter(~in_groups(keys, hot)), df.filter(in_groups(keys, hot))
        if self.hot is not None:
            segments = ceil(sum(hot.values()) / rows_per_task) + 1
            # Segment and position are written out with the row: range boundaries
            # are sampled, so a second computation could draw them elsewhere.
            self.hot = stored(
                self.hot.repartitionByRange(segments, *keys, *order)
                .sortWithinPartitions(*keys, *order)
                .withColumns({_SEGMENT: F.spark_partition_id(), _POSITION: F.monotonically_increasing_id()}),
                "segments",
            )

    def _add(self, name: str, plain: Callable, segmented: Callable) -> "Ordered":
        """New column from a window over whole groups, or over segments with a carry."""
        if self.cold is not None:
            self.cold = self.cold.withColumn(name, plain(self._window(False)))
        if self.hot is not None:
            self.hot = segmented(self._window(True)).drop("_carry")
        return self

    def _window(self, hot: bool):
        return W.partitionBy(*([_SEGMENT] if hot else []), *self.keys).orderBy(*self.order)

    def _with_carry(
        self, summary: Column, take: Callable[[WindowSpec], Column], backwards: bool = False
    ) -> DataFrame:
        """Hot rows joined with ``_carry``, taken from the summaries of the segments before.

        The carry table has at most one row per segment plus one per hot group
        (both bounded above), so broadcasting it is safe.
        """
        order = F.desc(_SEGMENT) if backwards else F.asc(_SEGMENT)
        before = W.partitionBy(*self.keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        carry = self.hot.groupBy(_SEGMENT, *self.keys).agg(summary.alias("_carry"))
        carry = carry.withColumn("_carry", take(before))
        renamed = carry.select([F.col(c).alias(c if c == "_carry" else f"_c_{c}") for c in carry.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in [_SEGMENT, *self.keys]]
        joined = self.hot.join(F.broadcast(renamed), same, "left")
        return joined.drop(*[f"_c_{c}" for c in [_SEGMENT, *self.keys]])

    def row_number(self, name: str) -> "Ordered":
        """Number of the row in its group, from 1.

        Segments are stored in order, so their rows need no further shuffle.
        """
        def segmented(window):
            summary = F.struct(F.count("*").alias("rows"), F.min(_POSITION).alias("first"))
            carried = self._with_carry(
                summary,
                lambda before: F.coalesce(F.sum("_carry.rows").over(before), F.lit(0)) - F.col("_carry.first"),
            )
            return carried.withColumn(name, F.col(_POSITION) + F.col("_carry") + 1)

        return self._add(name, lambda window: F.row_number().over(window).cast("bigint"), segmented)

    def running_sum(self, name: str, value: Column) -> "Ordered":
        total = F.sum(value)

        def segmented(window):
            here = total.over(window.rowsBetween(*_SO_FAR))
            carried = self._with_carry(total, lambda before: F.sum("_carry").over(before))
            return carried.withColumn(name, here + F.coalesce("_carry", F.lit(0)))

        return self._add(name, lambda window: total.over(window.rowsBetween(*_SO_FAR)), segmented)

    def running_max(self, name: str, value: Column) -> "Ordered":
        top = F.max(value)

        def segmented(window):
            here = top.over(window.rowsBetween(*_SO_FAR))
            carried = self._with_carry(top, lambda before: F.max("_carry").over(before))
            return carried.withColumn(name, F.greatest(here, "_carry"))

        return self._add(name, lambda window: top.over(window.rowsBetween(*_SO_FAR)), segmented)

    def running_min(self, name: str, value: Column) -> "Ordered":
        least = F.min(value)

        def segmented(window):
            here = least.over(window.rowsBetween(*_SO_FAR))
            carried = self._with_carry(least, lambda before: F.min("_carry").over(before))
            return carried.withColumn(name, F.least(here, "_carry"))

        return self._add(name, lambda window: least.over(window.rowsBetween(*_SO_FAR)), segmented)

    def trailing(self, name: str, aggregate: Column, at: str, span: int) -> "Ordered":
        """``aggregate`` over the rows of the group whose ``at`` lies up to ``span`` before, and those of equal ``at``.

        ``at`` is a number in the order of the rows. A segment borrows what lies so
        close to its ends from its neighbours ("halo"). A span that covers whole segments makes that many copies.
        """
        def segmented(window):
            ends = self.hot.groupBy(_SEGMENT, *self.keys).agg(F.min(at).alias("first"), F.max(at).alias("last"))
            # One entry per segment and hot group, so the arrays are short and few.
            around = ends.groupBy(*[F.col(c).alias(f"_c_{c}") for c in self.keys]).agg(
                F.collect_list(F.struct(F.col(_SEGMENT).alias("segment"), "first", "last")).alias("_ends")
            )
            same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in self.keys]
            near = F.filter(
                "_ends",
                lambda e: ((e["segment"] > F.col(_SEGMENT)) & (F.col(at) >= e["first"] - span))
                | ((e["segment"] < F.col(_SEGMENT)) & (F.col(at) == e["last"])),
            )
            halo = (
                self.hot.join(F.broadcast(around), same)
                .withColumn("_to", F.explode(F.transform(near, lambda e: e["segment"])))
                .drop("_ends", _SEGMENT, *[f"_c_{c}" for c in self.keys])
                .withColumnRenamed("_to", _SEGMENT)
                .withColumn("_halo", F.lit(True))
            )
            both = self.hot.withColumn("_halo", F.lit(False)).unionByName(halo)
            ranged = W.partitionBy(_SEGMENT, *self.keys).orderBy(at).rangeBetween(-span, 0)
            return both.withColumn(name, aggregate.over(ranged)).filter(~F.col("_halo")).drop("_halo")

        return self._add(name, lambda _: aggregate.over(W.partitionBy(*self.keys).orderBy(at).rangeBetween(-span, 0)), segmented)

    def previous(self, name: str, value: Column) -> "Ordered":
        """Value of the row before; NULL for the first row of a group."""
        return self._neighbour(name, value, F.lag, F.max_by, backwards=False)

    def following(self, name: str, value: Column) -> "Ordered":
        """Value of the row after; NULL for the last row of a group."""
        return self._neighbour(name, value, F.lead, F.min_by, backwards=True)

    def _neighbour(self, name, value, shift, edge_by, backwards) -> "Ordered":
        def segmented(window):
            # Wrapped in a struct, so that "no neighbour here" and "the neighbour
            # holds NULL" stay apart.
            boxed = F.struct(value.alias("value"))
            edge = edge_by(boxed, F.struct(*self.order))
            carried = self._with_carry(edge, lambda before: F.last("_carry").over(before), backwards)
            return carried.withColumn(name, F.coalesce(shift(boxed).over(window), "_carry")["value"])

        return self._add(name, lambda window: shift(value).over(window), segmented)

    def frame(self) -> DataFrame:
        parts = [self.cold] if self.cold is not None else []
        parts += [self.hot.drop(_SEGMENT, _POSITION)] if self.hot is not None else []
        return reduce(DataFrame.unionByName, parts)
