"""Connected components of a graph given as an edge table, by alternating star operations.

Edges with a null end, loops and repeated edges change nothing; the least node names its component, so there
are no ties; no edges give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import cut, discard


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of an edge (a, b), but the roots, with the smallest node that it reaches.

    Large-star, then small-star, until nothing changes; every round is written to the shared folder, so
    plans stay short and a lost executor costs one round at most; a round goes when the next is written.  Nothing
    is gathered on the driver but two sums.  Each join's one side has a row a node, so a hub is only a skewed join.
    """
    stars = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").where("v <> m").distinct()
        large = cut(large, "cc")
        # small-star: all of u's smaller neighbours, and u, to the least of them
        lower = large.groupBy("v").agg(F.min("m").alias("low"))
        joined = large.join(lower, "v")
        small = joined.select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(joined.select("v", F.col("low").alias("m"))).where("v <> m").distinct()
        before_round, stars = stars, cut(small, "cc")
        discard(before_round)
        discard(large)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("v").alias("node"), F.col("m").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
