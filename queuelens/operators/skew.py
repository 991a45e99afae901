"""Groups too large for one task: how to find them, and joins that survive them.

They are found by a mergeable frequency sketch over the keys. The sketch decides
only which way a group is computed, never the result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group with more rows than this is not left to one task.
ROWS_PER_TASK = 5_000_000

# The sketch is taken from a sample in which a group of that size still has this
# many rows. Smaller limits use every row.
ROWS_SAMPLED = 100_000

# Keys are dealt by hash over so many sketches, each with so many entries. A sketch
# finds every group above about 2 / TRACKED_GROUPS of its rows, so all groups of
# ROWS_PER_TASK are found in tables of up to SLOTS * TRACKED_GROUPS / 2 * ROWS_PER_TASK
# = 4 * 10**11 rows; beyond, raise SLOTS with the number of rows.
SLOTS = 16
TRACKED_GROUPS = 10_000


def _names(columns: list[str]) -> str:
    return ", ".join(f"`{name}`" for name in columns)


def group_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_groups(
    df: DataFrame, keys: list[str], rows_per_task: int | None = ROWS_PER_TASK
) -> dict[int, int]:
    """Hash and estimated size of the groups too large for one task.

    ``rows_per_task=None``: the caller knows that there are none.

    One pass over the key columns. Tasks send sketches, not rows; they are merged
    slot by slot, and at most ``SLOTS * TRACKED_GROUPS`` numbers reach the driver. A wrong
    estimate would only choose the slower way for a group.
    """
    if rows_per_task is None:
        return {}
    fraction = min(1.0, ROWS_SAMPLED / rows_per_task)
    keys_only = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction, seed=1)
    part = (F.spark_partition_id() % 256).alias("part")
    slot = F.pmod(group_hash(keys), F.lit(SLOTS)).alias("slot")
    accumulate = F.expr(f"approx_top_k_accumulate(xxhash64({_names(keys)}), {TRACKED_GROUPS})")
    combine = F.expr(f"approx_top_k_combine(sketch, {TRACKED_GROUPS})")
    top = (
        keys_only.groupBy(part, slot)
        .agg(accumulate.alias("sketch"))
        .groupBy("slot")
        .agg(combine.alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED_GROUPS})")).alias("top"))
        .select("top.item", (F.col("top.count") / fraction).cast("bigint").alias("rows"))
        .filter(F.col("rows") > rows_per_task)
        .collect()
    )
    return dict(map(tuple, top))


def in_groups(keys: list[str], hot: dict[int, int]) -> Column:
    return group_hash(keys).isin(list(hot))


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Left or left anti join with a side that has at most one row per key.

    Huge groups of the left side stay where they are: the rows they can meet are
    at most one per such group, so a bounded number, and are broadcast.
    """
    hot = hot_groups(left, keys, rows_per_task)
    if not hot:
        return left.join(right, keys, how)
    few = left.filter(~in_groups(keys, hot)).join(right.filter(~in_groups(keys, hot)), keys, how)
    many = left.filter(in_groups(keys, hot)).join(F.broadcast(right.filter(in_groups(keys, hot))), keys, how)
    return few.unionByName(many)
