"""Connected components of an edge table by alternating large-star and small-star rounds.

Published method: Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii, Connected Components in
MapReduce and Beyond, 2014. Every round is written to the shared folder; hubs are met by aggregation
before the join and by adaptive splitting of skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import materialise, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Self loops and repeated edges do no harm; no edges give no rows; null ends are dropped.
    """
    now = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large)
        # small star: edges already point from the larger to the smaller end
        least2 = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = materialise(small)
        remove(now, least, large, least2)
        now = after
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark:
            break
        mark = got
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
