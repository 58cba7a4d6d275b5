"""Connected components by contraction, for any number of links and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quitanda.llm.frames import Scratch, durable
from quitanda.session import compacted


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each end of the links (a, b).

    Every node points to its smallest neighbour or itself; pointers are followed to their
    roots by doubling, then each tree becomes one node.  Trees hold two nodes or more, so the
    rounds grow with the logarithm of the number of nodes.  Hot nodes only meet partial
    aggregation and joins that Spark may split.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.save(links.select("a", "b").filter("a <> b").distinct())
    # No frame has more rows than twice the edges: small ones are written by few tasks.
    most = 2 * edges.count()
    save = lambda df: scratch.save(compacted(df, most))
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = save(up.join(higher, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            up = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            above = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
            labels = labels.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            labels = save(labels)
        ends = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}"))
        edges = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        edges = save(edges.filter("a <> b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = durable(compacted(labels, most))
    scratch.clear()
    return labels
