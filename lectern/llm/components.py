"""Connected components by alternating large-star and small-star steps.

Every step is a pair of shuffles on one node of each edge; edges shrink towards
stars, and the number of rounds grows with the logarithm of the longest path.
Nothing is collected but one count a round.  Each round's edges are written to
the shared scratch space, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``u, v`` with u > v -> the same, hung up anew at the smallest neighbour.

    Large: the larger neighbours of each node go to the smallest node among its
    neighbours and itself.  Small: the smaller neighbours and the node itself do.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Only an edge seen from its smaller end has a larger neighbour to move.
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``a, b`` (longs, any order, repeats allowed) -> ``node, component`` for every node with an edge to another.

    ``component`` is the smallest node that can be reached.  No edges give no rows.
    """
    now = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges"
    )
    digest = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_stars(_stars(now, True), False), f"{name}-round")
        # Equal edge sets have equal digests, and a step that changes nothing has reached stars.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == digest or not seen[0]:
            break
        digest = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
