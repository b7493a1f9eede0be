"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Only joins and aggregations: no link or label reaches the driver, each round's edges are written to the shared folder,
and the number of rounds grows with the logarithm of a component's size. Hub rows are plain equi-join rows, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, drop_cut


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b: long, undirected; nulls and self-links count as none) -> (node, root): each node that has a link, with the smallest node reachable."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e = cut(e, "links")
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "links")
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_cut(e)
        e = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    both = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return both.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
