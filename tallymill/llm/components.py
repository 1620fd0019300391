"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored


def _flattened(parent: DataFrame) -> DataFrame:
    """Every node's farthest ancestor, by doubling the length of the hops."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("_far"))
        parent = stored(parent.select("node", "up").join(above, "up", "left").select(
            "node", F.coalesce("_far", "up").alias("up"), F.col("_far").isNotNull().alias("moved")), "hops")
        if parent.filter("moved").isEmpty():
            return parent.select("node", "up")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another one; root is the smallest node reachable.

    ``a`` and ``b`` are non-null bigints. In every round each node with a smaller neighbour hooks on to
    its smallest, chains are flattened by doubling, and the links are redrawn between the roots. At
    least half of the nodes still linked vanish per round, so rounds are logarithmic in the nodes.
    Minima are combined inside the map tasks; joins on a hub are ordinary joins that adaptive
    execution splits. Every round is stored in the shared folder.
    """
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links = stored(links.distinct(), "links")
    labels = None
    while not links.isEmpty():
        parent = _flattened(stored(links.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "node"), "parents"))
        hooked = parent.select("node", F.col("up").alias("root"))
        if labels is None:
            labels = hooked
        else:
            above = parent.select(F.col("node").alias("root"), F.col("up").alias("_up"))
            labels = stored(labels.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
                            .unionByName(hooked), "labels")
        high = parent.select(F.col("node").alias("hi"), F.col("up").alias("_a"))
        low = parent.select(F.col("node").alias("lo"), F.col("up").alias("_b"))
        redrawn = (links.join(high, "hi", "left").join(low, "lo", "left")
                   .select(F.coalesce("_a", "hi").alias("x"), F.coalesce("_b", "lo").alias("y")).filter("x <> y"))
        links = stored(redrawn.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
    if labels is None:
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return labels
