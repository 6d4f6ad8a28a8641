"""Connected components of a graph of any size by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut_lineage

#: Edges a task starts from. Fewer tasks than that need only cost time, and a round has several stages.
SLICE_EDGES = 20_000
#: Slices that even a small graph has.
LEAST_SLICES = 12


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round hangs the larger neighbours of a node under its smallest neighbour, then does the same
    among the smaller ones. Minima are combined before the shuffle, so a hub of millions of edges
    sends one row per task; joins on a hub are split by the adaptive skew join. A round is cut with a
    reliable checkpoint. Nodes without an edge do not appear; null ends are dropped.
    """
    cur = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a) != F.col(b))
        .toDF("u", "v", "other").where("other").select("u", "v").distinct()
    )
    n = cur.count()
    if not n:
        return cur.toDF("node", "component")
    # no round makes more edges than there were
    slices = max(LEAST_SLICES, -(-n // SLICE_EDGES))
    ends = lambda *pairs: F.inline(F.array(*[F.struct(F.col(x).alias("u"), y.alias(z)) for x, y, z in pairs]))
    cur = cur.coalesce(slices)
    for _ in range(most_rounds):
        # larger neighbours go under the smallest neighbour
        both = cur.select(ends(("u", F.col("v"), "v"), ("v", F.col("u"), "v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # smaller neighbours go under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(low, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut_lineage(low.toDF("u", "v").unionByName(moved).distinct().coalesce(slices))
        # done when every node hangs once and nothing hangs under it
        hangs = cur.select(ends(("u", F.lit(1), "n"), ("v", F.lit(0), "n")))
        hangs = hangs.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
        if not hangs.agg(F.count_if(F.expr("n > 1 or n = 1 and least = 0"))).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    top = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)
