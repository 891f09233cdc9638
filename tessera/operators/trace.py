"""Bounded breadth-first tracing over an adjacency: a level reads the buckets of its frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.model import DEFAULT_CONFIDENCE
from tessera.operators.adjacency import Adjacency
from tessera.staging import stage

DEFAULT_DEPTH, MOST_DEPTH = 2, 5
_WAYS = {"out": [0], "in": [1], "both": [0, 1]}


def start_node(graph: PropertyGraph, project_id: int, qualified_name: str, label: str | None = None) -> DataFrame:
    """The start node; without a label, of several nodes of that name the one of the smallest id."""
    found = graph.project_nodes(project_id).where(F.col("qualified_name") == qualified_name)
    if label:
        found = found.where(F.col("label") == label)
    return found.orderBy("id").limit(1)


def trace(
    graph: PropertyGraph,
    project_id: int,
    qualified_name: str,
    *,
    label: str | None = None,
    direction: str = "both",
    edge_types: list[str] | None = None,
    depth: int | None = None,
    min_confidence: float = DEFAULT_CONFIDENCE,
    adjacency: Adjacency | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached within ``depth`` levels, each with the level ``depth`` at which it came.

    The start node is level 0; an edge has the level of the step that crosses it first. Edges of an expanded node are
    all returned, also those to nodes seen before; nodes of the last level aren't expanded. An unknown start is an
    empty result. ``adjacency``: that of the project, to be built once for many traces; without it one is built here.
    """
    depth = min(DEFAULT_DEPTH if depth is None else depth, MOST_DEPTH)
    near = adjacency or Adjacency.build(graph, project_id)
    wanted = F.col("way").isin(_WAYS[direction]) & (F.col("confidence") >= min_confidence)
    if edge_types:
        wanted = wanted & F.col("edge_type").isin(edge_types)
    frontier = stage(start_node(graph, project_id, qualified_name, label).select("id", F.lit(0).alias("depth")))
    seen, crossed = [frontier], []
    for level in range(1, depth + 1):
        buckets = near.halves.buckets_of(frontier)
        if not buckets:
            break
        there = near.halves.read(buckets).where(wanted)
        step = stage(there.join(frontier.select(F.col("id").alias("near")), "near").select("edge_id", F.when(F.col("known"), F.col("far")).alias("id")))
        crossed.append(step.select(F.col("edge_id").alias("id"), F.lit(level).alias("depth")))
        # nodes of earlier levels come first: one aggregate finds the new ones
        both = reduce(DataFrame.unionByName, [*seen, step.where("id is not null").select("id", F.lit(level).alias("depth"))])
        frontier = stage(both.groupBy("id").agg(F.min("depth").alias("depth")).where(F.col("depth") == level))
        seen.append(frontier)
    nodes = reduce(DataFrame.unionByName, seen)
    edges = reduce(DataFrame.unionByName, crossed, frontier.where("false"))
    first = stage(edges.groupBy("id").agg(F.min("depth").alias("depth")))
    return near.nodes.fetch(nodes), near.edges.fetch(first)
