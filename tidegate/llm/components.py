"""Connected components of an edge table by alternating large and small stars.

Every step is a join on a vertex followed by a distinct; a vertex with very many
edges is a skewed join key with one row on the other side, which adaptive
execution splits. The edges of each round are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) hold u > v. One star step; the result again has u > v, without repeats."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored, so that the join's two sides are plain shuffles and a crowded vertex can be split
    least = stable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``root`` is the smallest node of its component.

    ``edges`` has columns a, b of one ordered type; direction, repeats, loops and
    NULL ends do not matter (rows with a NULL end are no edges). Rounds go on
    until the edges no longer change, which the stars always reach.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stable(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = stable(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
