"""Degrees and histograms as one table of counts that a commit's changes are merged into, so that no edge is read again.

``what`` is ``degree`` (``name`` an edge type: edges of that type that leave and that enter the node ``id``), ``type`` (edges
of the type ``name``) or ``label`` (nodes of the label ``name``); the last two have id 0 and count in ``outs``. A row whose
counts are zero isn't kept. A loop counts once on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DDL = "project_id long, what string, id long, name string, outs long, ins long"
_KEY = ["project_id", "what", "id", "name"]


def _entry(what: str, key: Column, name: str, outs: int, ins: int) -> Column:
    return F.struct(F.lit(what).alias("what"), key.cast("long").alias("id"), F.col(name).alias("name"), F.lit(outs).cast("long").alias("outs"), F.lit(ins).cast("long").alias("ins"))


def _summed(rows: DataFrame) -> DataFrame:
    """Added up by key, in each task before anything is shuffled, so that a hub is no hot key."""
    return rows.groupBy(*_KEY).agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins")).where("outs <> 0 or ins <> 0")


def _entries(nodes: DataFrame, edges: DataFrame, sign: int) -> DataFrame:
    ends = F.array(_entry("degree", F.col("source_id"), "edge_type", sign, 0), _entry("degree", F.col("target_id"), "edge_type", 0, sign), _entry("type", F.lit(0), "edge_type", sign, 0))
    labels = nodes.select("project_id", _entry("label", F.lit(0), "label", sign, 0).alias("e"))
    return edges.select("project_id", F.explode(ends).alias("e")).unionByName(labels).select("project_id", "e.*")


def counts_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The counts of these nodes and edges, of any number of projects."""
    return _summed(_entries(nodes, edges, 1))


def change(nodes_gone: DataFrame, edges_gone: DataFrame, nodes_new: DataFrame, edges_new: DataFrame) -> DataFrame:
    """What a commit adds to the counts, with signs; what came and went in equal numbers is no change."""
    return _summed(_entries(nodes_gone, edges_gone, -1).unionByName(_entries(nodes_new, edges_new, 1)))


def merged(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """``counts`` after ``changed``: keys that it doesn't name pass as they are, only the others are added up anew."""
    touched = changed.select(*_KEY)
    met = counts.join(touched, _KEY, "left_semi").select(*changed.columns).unionByName(changed)
    return counts.join(touched, _KEY, "left_anti").select(*changed.columns).unionByName(_summed(met).select(*changed.columns))


def degrees(counts: DataFrame, project_id: int, edge_type: str | None = None, direction: str = "both") -> DataFrame:
    """id, edge_type and degree of every node that has one, a row a node and type as they are stored."""
    degree = {"out": F.col("outs"), "in": F.col("ins"), "both": F.col("outs") + F.col("ins")}[direction]
    found = counts.where((F.col("project_id") == project_id) & (F.col("what") == "degree"))
    if edge_type is not None:
        found = found.where(F.col("name") == edge_type)
    return found.select("id", F.col("name").alias("edge_type"), degree.alias("degree")).where("degree > 0")


def histogram(counts: DataFrame, project_id: int, what: str) -> DataFrame:
    """label and count, or edge_type and count, of the project: ``what`` is ``label`` or ``type``."""
    named = {"label": "label", "type": "edge_type"}[what]
    return counts.where((F.col("project_id") == project_id) & (F.col("what") == what)).select(F.col("name").alias(named), F.col("outs").alias("count"))
