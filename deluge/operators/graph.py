"""Connected components of a link table by hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns): root is the smallest node of its component.

    Each round hooks every root to the smallest root linked to it, lets nodes jump to their
    root's root until that changes nothing, and replaces links by those between roots.  Links
    within a component vanish, so rounds work on ever fewer rows; no component is gathered.
    """
    edges = cut_lineage(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u is not null"))
    names = cut_lineage(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")))
    edges = edges.where("u != v")
    while True:
        edges = cut_lineage(edges.distinct())
        if edges.isEmpty():
            return names
        hook = cut_lineage(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up")))
        while True:  # chains of hooks halve
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut_lineage(hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"),
                                                                       F.col("top").isNotNull().alias("moved")))
            hook = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        to = hook.select(F.col("node").alias("root"), "up")
        names = cut_lineage(names.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))

        def moved(df, c):
            return df.join(to.withColumnRenamed("root", c), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        edges = moved(moved(edges, "u"), "v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v")
