"""Connected components by alternating large-star and small-star steps, all as joins and minima.

Every step keeps components and only ever points nodes at smaller ones.  It ends when a round leaves the
edges as they were, after which each node is linked to the smallest node of its component.  Hot nodes cost
partial minima and many-to-one joins against a written table, whose skew Spark splits at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import Scratch


def _star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (u, v) with m, the smallest of u and its partners."""
    mins = scratch.keep(links.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name)
    return links.join(mins, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has longs u and v.  Returns (node, root) for every node of an edge, root the smallest of its component."""
    pairs = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.keep(pairs(edges), "edges_0")
    mark, step = None, 0
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark, step = seen, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch, f"large_{step}").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(pairs(large), f"stars_{step}")
        small = _star(large, scratch, f"small_{step}")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = scratch.keep(pairs(small), f"edges_{step}")
        scratch.drop(f"edges_{step - 1}", f"large_{step}", f"stars_{step}", f"small_{step}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
