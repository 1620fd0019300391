"""Workflows of several nodes, each working on the successful outputs of others."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.plans.ordered import global_number, union_all
from tallymill.session import checkpointed


@dataclass(frozen=True)
class Node:
    """``run`` maps items (ord, text) to results (ord, status, final_output). ``ord`` only names and orders
    the items: the given number in a node without dependencies, a place (array of numbers) in the others."""

    id: str
    run: Callable[[DataFrame], DataFrame]
    depends_on: tuple[str, ...] = ()


def run_order(nodes: list[Node]) -> list[str]:
    """Node ids, dependencies first; an error for cycles and unknown ids."""
    known = {n.id for n in nodes}
    unknown = {d for n in nodes for d in n.depends_on} - known
    if unknown:
        raise ValueError(f"unknown dependencies: {sorted(unknown)}")
    return list(TopologicalSorter({n.id: n.depends_on for n in nodes}).static_order())


def run_workflow(nodes: list[Node], items: DataFrame) -> dict[str, DataFrame]:
    """Results of every node that had input, in run order; the last entry is the workflow's result.

    A node with dependencies works on their successful outputs, in the order they are listed. Texts stay
    where they are: an item's place is the number of its source followed by its place there, and places
    order as the items do. ``numbered`` gives dense numbers. Results are checkpointed once, as several
    nodes may read them.
    """
    by_id = {n.id: n for n in nodes}
    results: dict[str, DataFrame] = {}
    outputs: dict[str, DataFrame] = {}
    for node_id in run_order(nodes):
        node = by_id[node_id]
        if node.depends_on:
            feeding = [_placed(outputs[d], i) for i, d in enumerate(node.depends_on) if d in outputs]
            for missing in set(node.depends_on) - outputs.keys():
                warnings.warn(f"node {node_id}: no output from {missing}", stacklevel=2)
            if not feeding:
                continue
            source = union_all(feeding)
        else:
            source = items.select("ord", "text")
        results[node_id] = checkpointed(node.run(source))
        good = results[node_id].filter(F.col("status") == "success").select("ord", F.col("final_output").alias("text"))
        if not good.isEmpty():
            outputs[node_id] = good
    return results


def _placed(outputs: DataFrame, source: int) -> DataFrame:
    place = F.col("ord") if outputs.schema["ord"].dataType.typeName() == "array" else F.array(F.col("ord").cast("bigint"))
    return outputs.withColumn("ord", F.concat(F.array(F.lit(source).cast("bigint")), place))


def numbered(results: DataFrame) -> DataFrame:
    """``results`` with dense numbers from 1 as ``ord``, in the order of their places. The other columns move
    with it, so select narrow ones first."""
    return global_number(results.withColumnRenamed("ord", "_place"), ["_place"], "ord").select(*results.columns)


def node_stats(results: dict[str, DataFrame]) -> DataFrame:
    """Pass rate and volume per node."""
    rows = union_all([df.select(F.lit(n).alias("node_id"), "status") for n, df in results.items()])
    return rows.groupBy("node_id").agg(F.avg((F.col("status") == "success").cast("double")).alias("pass_rate"),
                                       F.count("*").alias("total_processed"))
