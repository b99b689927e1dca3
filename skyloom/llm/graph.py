"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (columns a, b) with the smallest node it can reach. Minima are
    taken by aggregation and joined back, so that a hub is no group that one task must hold. Edges with a
    null end are ignored. Raises if ``rounds`` do not suffice (they double the reach each time)."""
    state = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        sym = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(state.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u")
        after = cut(both.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        roots = after.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        open_ = after.join(roots.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() + roots.filter("n > 1").limit(1).count()
        state = after
        if not open_:  # every node points once, at a node that points nowhere
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
    raise RuntimeError(f"components need more than {rounds} rounds")
