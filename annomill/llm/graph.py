"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregation and a join over links; nothing is collected, and each result is written to the shared folder,
so lineage stays short and lost executors cost one step at most; a step's tables are removed after it. As both sides of a join are then read from files, Spark
can split the links of a node that very many others link to over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v); root is the least node reachable. Loops and repeated links are allowed."""
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        nearest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(nearest.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.filter("u != v").distinct(), "links")
        forget(before, least, large, nearest)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
