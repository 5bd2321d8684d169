"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint


def state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def large_star(links: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours onto the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours, and itself, onto the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; ``links`` has long columns u and v.

    A component is named by its smallest node. Links of a node to itself and repeated links change nothing;
    links with a null end are no links. Each round is checkpointed, so that lost executors cost one round;
    only two numbers a round reach the driver.
    """
    proper = links.where("u is not null and v is not null and u <> v")
    now = checkpoint(proper.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    for _ in range(rounds if before[0] else 0):
        now = checkpoint(small_star(large_star(now)))
        if (after := state(now)) == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
