"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every end of a link but the roots; root: the smallest end of the component.

    Large star: everything above a node moves to the node's smallest neighbour.
    Small star: everything below a node does. Both work on grouped minima and
    joins, so that no neighbourhood is ever collected; each round is written to
    the shared folder. Rounds grow with the logarithm of a component's size.
    """
    edges = written(_down(links), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionAll(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _down(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
