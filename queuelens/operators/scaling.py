"""Scaling policies and the number of workers they call for."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.scalars import desired_replicas
from queuelens.operators.ordered import Ordered
from queuelens.operators.skew import ROWS_PER_TASK, join_unique
from queuelens.schemas import POLICY
from queuelens.session import is_small


class Policy(NamedTuple):
    """The base scaling policy. Durations in seconds."""

    min_replicas: int = 0
    max_replicas: int = 5
    poll_s: int = 15
    cooldown_s: int = 30
    stabilization_s: int = 30
    queue_length: int = 5
    in_flight: bool = False


def resolve_policy(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Policy per environment; a field set in the overlay replaces the base field."""
    fields = [f.name for f in POLICY if f.name != "env"]
    renamed = overlay.select("env", *[F.col(f).alias(f"over_{f}") for f in fields])
    renamed = F.broadcast(renamed) if is_small(renamed) else renamed
    return base.join(renamed, "env", "left").select(
        "env", *[F.coalesce(f"over_{f}", f).alias(f) for f in fields]
    )


def with_policy(
    series: DataFrame, policy: DataFrame, rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Attach the policy of its environment to every row of ``series``."""
    if is_small(policy):
        return series.join(F.broadcast(policy), "env", "left")
    return join_unique(series, policy, ["env"], "left", rows_per_task)


def recommend_replicas(
    series: DataFrame,
    policy: Policy | None,
    tick_s: int,
    longest_s: int | None = None,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Workers wanted per queue and tick; input (queue, tick, depth) at every tick.

    ``desired`` is the rounded-up backlog per worker. ``stabilized`` is its
    highest value within the stabilisation time, both ends included. A queue
    that was busy less than the cooldown ago keeps at least one worker.

    Without ``policy`` every row carries its own, as ``with_policy`` attaches it; ``env`` is
    kept. ``longest_s`` then bounds the stabilisation times: what lies further back is not
    looked at. A queue with more than ``rows_per_task`` ticks is worked out by many tasks; ``None``: there is none.
    """
    own = policy is None
    if own and longest_s is None:
        raise ValueError("policies of rows need longest_s")

    def setting(name: str):
        return F.col(name) if own else F.lit(getattr(policy, name))

    at = F.col("tick") * tick_s
    wanted = series.withColumn("at", at).withColumn(
        "desired",
        desired_replicas(F.col("depth"), setting("queue_length"), setting("min_replicas"), setting("max_replicas")),
    )
    ordered = Ordered(wanted, ["queue"], ["at"], rows_per_task)
    if own:
        # A frame has one length for all rows; the few ticks in it are cut to each row's own time.
        ordered.trailing("_seen", F.collect_list(F.struct("at", "desired")), "at", longest_s)
        lately = F.filter("_seen", lambda x: x["at"] >= F.col("at") - F.col("stabilization_s"))
        stabilized = F.array_max(F.transform(lately, lambda x: x["desired"]))
    else:
        ordered.trailing("_highest", F.max("desired"), "at", policy.stabilization_s)
        stabilized = F.col("_highest")
    ordered.running_max("last_active", F.when(F.col("depth") > 0, F.col("at")))
    smoothed = ordered.frame().withColumn("stabilized", stabilized)
    cooling = (F.col("depth") == 0) & (F.col("at") - F.col("last_active") < setting("cooldown_s"))
    return smoothed.select(
        *(["env"] if own else []),
        "queue",
        "tick",
        "depth",
        "desired",
        "stabilized",
        F.when(cooling, F.greatest("stabilized", F.lit(1))).otherwise(F.col("stabilized")).alias("replicas"),
    )
