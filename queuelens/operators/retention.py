"""Retention marks and change detection on versioned rows."""

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.functions.scalars import fingerprint, plus_seconds
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK, join_unique

# Tag prefixes that count as a release, and how many are kept.
TAG_PREFIXES = ["v", "sha-", "latest"]
KEEP = 10

# Spark's own limit (spark.sql.optimizer.windowGroupLimitThreshold): up to this rank a task
# drops the rows of a key that cannot count before they are shuffled.
LIMITED_IN_TASK = 1_000

# Fixed values, in seconds: retention of messages, of dead letters, of untagged versions.
MESSAGE_RETENTION = 345_600
DEAD_LETTER_RETENTION = 1_209_600
UNTAGGED_RETENTION = 86_400


def retain_latest(
    df: DataFrame,
    n: int = KEEP,
    prefixes: list[str] = TAG_PREFIXES,
    key: str = "repo",
    order: tuple[str, ...] = ("pushed_at", "id"),
    tag: str = "tag",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``expire``: tagged rows older than the ``n`` latest of their key.

    Rows whose tag has none of the prefixes neither count nor expire, nor do rows
    without a key. Only the
    ``n`` latest rows per task and key are shuffled to find the oldest row to
    keep; the whole table is then compared with that one row per key.
    """
    counts = _begins_with(tag, prefixes)
    releases = df.filter(counts & F.col(key).isNotNull()).select(key, *order)
    oldest_kept = _oldest_kept(releases, key, order, n, rows_per_task)
    older = F.coalesce(F.struct(*order) < F.col("_oldest"), F.lit(False))
    marked = join_unique(df, oldest_kept, [key], "left", rows_per_task)
    return marked.withColumn("expire", counts & older).drop("_oldest")


def _begins_with(tag: str, prefixes: list[str]) -> Column:
    return F.coalesce(F.col(tag).rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"), F.lit(False))


def _oldest_kept(releases: DataFrame, key: str, order: tuple[str, ...], n: int, rows_per_task: int | None) -> DataFrame:
    """Of each key with ``n`` rows or more the ``n``-th latest, as ``_oldest``."""
    if n <= LIMITED_IN_TASK:
        newest_first = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
        ranked = releases.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") == n)
    else:
        # Tasks no longer cut down their rows: number them without one task per key, and count from the end.
        numbered = Ordered(releases, [key], list(order), rows_per_task).row_number("rank").frame()
        sizes = releases.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        ranked = join_unique(numbered, sizes, [key], "inner", rows_per_task).filter(F.col("rank") == F.col("rows") - n + 1)
    return ranked.select(key, F.struct(*order).alias("_oldest"))


class RetentionRule(NamedTuple):
    """One rule: ``count`` keeps the ``limit`` latest rows of a key, ``age`` those of the last ``limit`` seconds.

    It looks at rows whose tag begins with one of ``prefixes``, at untagged rows, or at any row if neither is asked for.
    """

    priority: int
    kind: str
    limit: int
    prefixes: tuple[str, ...] = ()
    untagged: bool = False


# The last ten releases are kept, what has no tag goes after a day.
RULES = [RetentionRule(1, "count", KEEP, tuple(TAG_PREFIXES)), RetentionRule(2, "age", UNTAGGED_RETENTION, untagged=True)]


def rules_from(table: DataFrame) -> list[RetentionRule]:
    """Rules out of a table with the fields of ``RetentionRule``; a rule set is a handful of rows, so more than 1,000 are an error."""
    rows = table.select(*RetentionRule._fields).limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("a rule set has at most 1,000 rules")
    return [RetentionRule(r.priority, r.kind, r.limit, tuple(r.prefixes or ()), bool(r.untagged)) for r in rows]


def apply_rules(
    df: DataFrame,
    rules: list[RetentionRule],
    as_of: str,
    key: str = "repo",
    order: tuple[str, ...] = ("pushed_at", "id"),
    at: str = "pushed_at",
    tag: str = "tag",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``rule``, the priority of the rule that claims a row, and ``expire``, whether that rule lets it go.

    All rules are evaluated together: the rule of the least priority that looks at a row claims it, and later ones
    neither count nor expire it. Rows no rule looks at stay. A count rule needs a key, and
    leaves rows without one. The rules are one expression per row; each count rule shuffles what ``retain_latest``
    does, and the table is compared with one row per key and count rule.
    """
    rules = sorted(rules)
    if len({r.priority for r in rules}) < len(rules) or any(r.kind not in ("count", "age") or r.limit < 0 for r in rules):
        raise ValueError("rules have a priority of their own, a kind count or age, and a limit of 0 or more")

    def looks_at(rule: RetentionRule) -> Column:
        if rule.untagged and rule.prefixes:
            raise ValueError("a rule looks at tags or at untagged rows")
        if rule.untagged:
            return F.col(tag).isNull()
        return _begins_with(tag, list(rule.prefixes)) if rule.prefixes else F.lit(True)

    claim, expired = F.lit(None).cast("int"), F.lit(False)
    for rule in reversed(rules):
        claim = F.when(looks_at(rule), F.lit(rule.priority)).otherwise(claim)
    marked = df.withColumn("rule", claim)
    moment = F.lit(as_of).cast("timestamp_ntz")
    floors = []
    for rule in rules:
        mine = F.coalesce(F.col("rule") == rule.priority, F.lit(False))
        if rule.kind == "age":
            expired = expired | (mine & F.coalesce(F.col(at) < plus_seconds(moment, -rule.limit), F.lit(False)))
        elif rule.limit == 0:
            expired = expired | (mine & F.col(key).isNotNull())
        else:
            releases = marked.filter(mine & F.col(key).isNotNull()).select(key, *order)
            floors.append(_oldest_kept(releases, key, order, rule.limit, rows_per_task).withColumn("rule", F.lit(rule.priority)))
    if floors:
        # One row per key and rule, folded to one row per key: the table is joined once.
        by_rule = F.map_from_entries(F.collect_list(F.struct("rule", "_oldest")))
        oldest = reduce(DataFrame.unionByName, floors).groupBy(key).agg(by_rule.alias("_floors"))
        marked = join_unique(marked, oldest, [key], "left", rows_per_task)
        older = F.struct(*order) < F.try_element_at("_floors", F.coalesce("rule", F.lit(-1)))
        counting = [r.priority for r in rules if r.kind == "count" and r.limit]
        expired = expired | (F.coalesce(F.col("rule").isin(counting), F.lit(False)) & F.coalesce(older, F.lit(False)))
    return marked.withColumn("expire", expired).select(*df.columns, "rule", "expire")


def expire_by_age(
    df: DataFrame, ts: str, retention_s: int, as_of: str, predicate: Column | None = None
) -> DataFrame:
    """Adds ``expire``: rows (that satisfy ``predicate``) older than the retention."""
    limit = plus_seconds(F.lit(as_of).cast("timestamp_ntz"), -retention_s)
    # Never NULL, yet a plain comparison: a filter on it still reaches the scan.
    expired = F.col(ts).isNotNull() & (F.col(ts) < limit)
    if predicate is not None:
        expired = expired & F.coalesce(predicate, F.lit(False))
    return df.withColumn("expire", expired)


def detect_changes(
    df: DataFrame,
    key: list[str],
    order: list[str],
    cols: list[str],
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``fingerprint`` of ``cols`` and ``changed``: differs from the version before.

    The first version of a key has nothing before it and counts as changed.
    """
    marked = df.withColumn("fingerprint", fingerprint(*cols))
    versions = Ordered(marked, key, order, rows_per_task).previous("_before", F.col("fingerprint"))
    return (
        versions.frame()
        .withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("_before")))
        .drop("_before")
    )
