"""Connected components of a table of links, in Spark alone: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, meet

#: Links up to which a hub's may meet in one task.
FEW_LINKS = 1 << 20


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node's neighbours (greater ones, or smaller ones and itself) are linked to its smallest neighbour or itself.

    Of many links, a hub's stay where they are: ``meet`` sends the hub's smallest neighbour to them."""

    def met(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
        return meet(links, least, "a", "many", total) if total > FEW_LINKS else links.join(least, "a")

    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("many"))
        out = met(both.where("b > a"), least, 2 * total).select("b", "m")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many"))
        out = met(down, least, total).select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return out.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node it reaches) for every node of links (a, b: long)."""
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, total = None, edges.count()
    while True:
        # a large step makes no more links than there are
        edges = cut(_star(_star(edges, True, total), False, total))
        # the same sums and count twice: stars that no step changes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, total = tuple(now), now[0]
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
