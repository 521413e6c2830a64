"""Connected components by alternating large-star and small-star steps, as Spark joins.

Each round replaces a node's links by links to the smallest neighbour, so depth halves and
the links end as one star per component.  A hub with very many links is the skewed side of a
join against one row, which adaptive execution splits; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``(u, v)`` that is not its component's smallest."""
    turned = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, seen = cut(turned.where("u > v").distinct()), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select("u", F.col("m").alias("v"))
                    .unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                    .distinct())
