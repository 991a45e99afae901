"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    tied = edges.join(_least(edges), "u")
    return (
        tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(tied.select("u", F.col("m").alias("v")))
        .filter("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, least: every node of ``edges`` (columns u, v) with the least node it is connected to.

    A round is two joins on the node; a node with very many neighbours is reduced to
    its least neighbour in each task first. Rounds grow with the logarithm of the
    longest path. Each round is a written table, so its lineage is one round long.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, seen = None, mark(now)
    while seen != before:
        now = stored(_small_star(_large_star(now)), "edges")
        before, seen = seen, mark(now)
    least = now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).union(least)
