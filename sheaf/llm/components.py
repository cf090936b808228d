"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node of a link.

    Each round points every node at the smallest node next to it; the number of
    rounds grows with the logarithm of a component's width. The table of each
    round is written to the shared folder. Loops and repeated links do no harm;
    null ends are left out.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: the larger neighbours of u hang on the smallest node around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        # Both tables hold each edge once: they are equal if they are as many and none is new.
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    flat = edges.groupBy("u").agg(F.min("v").alias("component"))
    return flat.select(F.col("u").alias("node"), "component").unionByName(flat.select(F.col("component").alias("node"), "component").distinct())
