"""Following chains of pointers in a table with few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import checkpointed


def reachable(edges: DataFrame, starts: DataFrame, key: list[str], node: str, successor: str) -> DataFrame:
    """All (key..., node) met when following ``node -> successor`` from ``starts``, starts included.

    ``edges`` has at most one successor per (key, node) and no cycle. Every round doubles the length
    of the jumps, so a chain of n rows takes about log2(n) rounds, each two joins on a unique key.
    Rounds are checkpointed: the plan stays short and a lost executor cannot undo finished rounds.
    """
    jump = edges.filter(F.col(successor).isNotNull()).select(*key, node, successor)
    found = starts.select(*key, node)
    while True:
        ahead = found.join(jump, [*key, node]).select(*key, F.col(successor).alias(node))
        found = checkpointed(found.unionByName(ahead).distinct())
        onward = jump.select(*key, F.col(node).alias(successor), F.col(successor).alias("_far"))
        jump = checkpointed(jump.join(onward, [*key, successor]).select(*key, node, F.col("_far").alias(successor)))
        if jump.isEmpty():
            return found
