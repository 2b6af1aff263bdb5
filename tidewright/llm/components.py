"""Connected components by alternating stars, in DataFrame operations only.

Each round replaces the edges by stars: every node points its larger neighbours to the smallest
node it sees (large star), then its smaller neighbours and itself (small star). Minima combine on
the map side. The join back to them is by node, so the edges of a hub meet in one task of a round
unless adaptive execution splits that partition; rows there are two ids wide, and after the first
rounds each node has one edge. Edges never exceed their first number, rounds are about the logarithm of
the longest path squared at worst, and each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: columns a and b of one orderable type. Returns (node, root), root being the smallest
    node of the component, for every node of at least one edge between two different nodes.

    Nulls, self-loops and repeated edges are ignored; no edges give an empty result.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        wide = cut(_large_star(now), "large", 2 * before[0])
        after = cut(_small_star(wide), "small", 2 * before[0])
        state = _state(after)
        drop_cut(now)
        drop_cut(wide)
        now = after
        if state == before:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
