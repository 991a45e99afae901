"""Row validation: named predicates, and the list of those a row violates."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    holds: Column


def required(column: str) -> Rule:
    return Rule(f"{column}_required", F.trim(column) != "")


def not_placeholder(column: str, marker: str = "REPLACE") -> Rule:
    return Rule(f"{column}_placeholder", ~F.contains(F.col(column), F.lit(marker)))


def max_length(column: str, limit: int) -> Rule:
    return Rule(f"{column}_length", F.length(column) <= limit)


def matches(column: str, pattern: str) -> Rule:
    return Rule(f"{column}_pattern", F.col(column).rlike(pattern))


def one_of(column: str, values: list) -> Rule:
    return Rule(f"{column}_member", F.col(column).isin(values))


def in_range(column: str, low, high) -> Rule:
    return Rule(f"{column}_range", F.col(column).between(low, high))


def array_size(column: str, size: int) -> Rule:
    return Rule(f"{column}_size", F.size(column) == size)


def check_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``violations`` (names in rule order) and ``is_valid``.

    A rule that evaluates to NULL counts as violated.
    """
    broken = [F.when(~F.coalesce(rule.holds, F.lit(False)), rule.name) for rule in rules]
    return df.withColumn("violations", F.array_compact(F.array(*broken))).withColumn(
        "is_valid", F.size("violations") == 0
    )
