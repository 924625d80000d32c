"""Connected components of an edge table, by alternating stars.

Each round points the larger neighbours of every node at its smallest neighbour, then does the same
for the smaller ones, until nothing changes. All steps are grouped minima and equality joins, so a
node with very many neighbours is pre-aggregated, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is named by its
    smallest node. Loops, repeated edges and either direction are fine; no edges, no rows."""
    small = F.least("a", "b").alias("low")
    links = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("high"), small).distinct(), "links")
    before = None
    while True:
        both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        outer = both.join(least, "node").where("other > node").select(F.col("other").alias("high"), F.col("root").alias("low")).distinct()
        down = outer.groupBy("high").agg(F.min("low").alias("root"))
        inner = outer.join(down, "high")
        links = stored(
            inner.where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low")).unionByName(down.select("high", F.col("root").alias("low"))).distinct(),
            "links",
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
