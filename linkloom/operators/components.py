"""Connected components of an edge table by alternating star contractions.

Each round is two aggregations and two joins: every node first hands its larger neighbours to its
smallest neighbour, then its smaller neighbours. The rounds end when the edge table no longer changes;
then every node hangs on the smallest node of its component. The edges stay distributed: the driver
sees a count and a sum per round. Each round's table goes to the shared folder, so lost executors cost
one round at most, and joins on a hot node are left to adaptive execution, which can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import remove, write_table


def _stars(edges: DataFrame) -> DataFrame:
    """One round on distinct (u, v), u > v. A node's smaller neighbours stand in its own rows, so no edge is turned round to find the smallest."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    # a node's row with its smallest neighbour stays, the other neighbours move there
    hung = large.join(root, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return hung.distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that links reach.

    Null ends and self-links are ignored, repeated and reversed edges count once; an empty table gives
    an empty result. Nodes may be of any type with an order.
    """
    spark = edges.sparkSession
    now = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    )
    now, path = write_table(now.distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        after, after_path = write_table(_stars(now), "stars")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = after, after_path
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.union(roots.select("u", F.col("u").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("component"))
