"""Connected components of a link table by alternating large and small stars.

Every round is two joins with the smallest neighbour of each node, so a hub
with any number of links costs an aggregate (combined map-side) and a join
whose other side has one row per node.  The rounds end when the link table
has become a set of stars, i.e. no longer changes; their number grows with
the logarithm of the longest path.  Each round is written with
``checkpoint()``, so lost executors cost one round and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with a link; root is the smallest node reachable.

    Links are undirected; null ends and links of a node with itself are
    ignored, repeated links count once; no links give no rows.
    """
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint())
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = (both.join(low, "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))
