"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded

#: A node with more edges than this is a hub: its edges are dealt to several tasks.
HUB_EDGES = 100_000


def _joined(edges: DataFrame, least: DataFrame, stage: Stage, name: str, hub_edges: int) -> DataFrame:
    """Edges with `_least` of their node `a`; a hub's edges are cut by the other end, its least is copied per cut."""
    hubs = edges.groupBy("a").agg(F.count(F.lit(1)).alias("_edges")).where(F.col("_edges") > hub_edges)
    hubs = stage.put(hubs.select("a", F.ceil(F.col("_edges") / hub_edges).cast("int").alias("_cuts")), name)
    count = hubs.count()
    if not count:
        return edges.join(least, "a")
    hubs, cuts = bounded(hubs, count, 16), F.coalesce("_cuts", F.lit(1))
    dealt = edges.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), cuts).cast("int").alias("_cut"))
    copies = least.join(hubs, "a", "left").select("a", "_least", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("_cut"))
    return dealt.join(copies, ["a", "_cut"]).drop("_cut")


def _large_star(edges: DataFrame, stage: Stage, name: str, hub_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_least"))
    found = _joined(both, least, stage, name, hub_edges)
    return found.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))


def _small_star(edges: DataFrame, stage: Stage, name: str, hub_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_least"))
    below = _joined(down, least, stage, name, hub_edges).where("b <> _least")
    below = below.select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return below.unionByName(least.withColumnRenamed("_least", "b"))


def roots(edges: DataFrame, stage: Stage, hub_edges: int = HUB_EDGES) -> DataFrame:
    """node and the least node of its component, for all nodes with an edge; edges are a, b.

    Rounds repeat until every edge points at a root that points nowhere; their number grows with the
    logarithm of the longest path.
    """
    current = stage.put(edges.where("a <> b").select("a", "b").distinct(), "edges-0")
    number = 0
    while True:
        number += 1
        large = _large_star(current, stage, f"hubs-{number}-large", hub_edges).where("a <> b").distinct()
        large = stage.put(large, f"large-{number}")
        step = _small_star(large, stage, f"hubs-{number}-small", hub_edges).where("a <> b").distinct()
        step = stage.put(step, f"edges-{number}")
        stage.drop(f"large-{number}")
        stage.drop(f"edges-{number - 1}")
        inner = step.select(F.col("b").alias("a")).distinct().join(step.select("a").distinct(), "a", "left_semi")
        several = step.groupBy("a").count().where("count > 1")
        if inner.unionByName(several.select("a")).isEmpty():
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current = step
