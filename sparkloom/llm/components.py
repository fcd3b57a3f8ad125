"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations and two joins over the edge table. A hub's rows are pre-aggregated before they are
shuffled and joined under AQE's skew splitting, so no task needs all of a hub's neighbours. Every round is written to the
shared folder; nothing is collected but an edge count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v), undirected, u <> v -> (node, component): every node that has an edge, with its smallest reachable node.

    Repeated edges count once; an empty table gives an empty result.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        nxt = cut(_small_star(_large_star(now)), "edges")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = nxt
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
