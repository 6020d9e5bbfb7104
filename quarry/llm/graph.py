"""Connected components of an edge table, for classes of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root: every node of *edges* (bigint) with the smallest node it can reach.

    Each round hooks every node onto its smallest neighbour, follows the hooks to their roots by
    doubling, and contracts the edges onto the roots; every component loses half of its nodes at
    least, so the rounds grow with the logarithm of the nodes. All steps are joins and minima that
    are combined before the shuffle; a node of many edges is never collected. Lineage is cut each round.
    """
    e = cut(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while e.take(1):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nxt = cut(hook.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            done = not nxt.filter("moved").take(1)
            hook = nxt.select("node", "root")
            if done:
                break
        if labels is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        la = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        lb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = cut(e.join(la, "a").join(lb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
