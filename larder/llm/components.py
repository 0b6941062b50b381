"""Connected components of links, by joins and checkpoints.

Every round links each node to the smallest of its smaller neighbours, and its other smaller neighbours to that one too; then
each node jumps to its neighbour's neighbour, so that long chains shrink as fast as wide stars. When each node has one
smaller neighbour left, the links are a forest whose roots are the smallest nodes, and jumps alone lead to the roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import durable


def _jump(lows: DataFrame) -> DataFrame:
    """node, low -> node, low of low (or low), moved. Both sides are stored frames, so that a hot low can be split."""
    above = lows.select(F.col("node").alias("low"), F.col("low").alias("lower"))
    return lows.join(above, "low", "left").select(
        "node", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")
    )


def components(links: DataFrame) -> DataFrame:
    """links (a, b), null-free, in any order, repeats allowed -> node, component (smallest node reachable).

    Smallest nodes themselves, and nodes without a link to another one, are not listed; no links give no rows.
    """
    edges = durable(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct())
    while True:
        lows = durable(edges.groupBy("node").agg(F.min("low").alias("low")))
        others = edges.withColumnRenamed("low", "other").join(lows, "node").where(F.col("other") != F.col("low"))
        more = durable(others.select(F.greatest("other", "low").alias("node"), F.least("other", "low").alias("low")).distinct())
        if more.isEmpty():
            break
        edges = durable(_jump(lows).select("node", "low").union(more))
    while True:
        stepped = durable(_jump(lows))
        lows = stepped.select("node", "low")
        if stepped.where("moved").isEmpty():
            return lows.withColumnRenamed("low", "component")
