"""Filtered search over a project's nodes, with degree predicates and stable paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import glob_pattern, ignore_case, property_is
from tessera.graph import PropertyGraph
from tessera.operators import counts as kept_counts
from tessera.operators.name_index import NameIndex

# Annotations that mark code which something outside calls.
ENTRY_ANNOTATIONS = "auraenabled invocablemethod istest httpget httppost httpput httppatch httpdelete".split()
COMPACT = ("id", "label", "name", "qualified_name", "file_path", "start_line")
MOST_ROWS, DEFAULT_ROWS = 500, 50


@dataclass(frozen=True)
class Degree:
    """Edges of a type at a node: ``in``, ``out`` or ``both`` (a loop counts twice). A maximum of 0 implies a minimum
    of 0; otherwise the minimum is 1 by default."""

    edge_type: str
    direction: str = "both"
    least: int | None = None
    most: int | None = None

    @property
    def floor(self) -> int:
        return self.least if self.least is not None else 0 if self.most == 0 else 1


def degrees(graph: PropertyGraph, project_id: int, edge_type: str | None = None, direction: str = "both") -> DataFrame:
    """id, edge_type and degree of every node that has one; ends are counted before they are shuffled."""
    edges = graph.project_edges(project_id)
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    ends = {"out": ["source_id"], "in": ["target_id"], "both": ["source_id", "target_id"]}[direction]
    sides = [edges.select(F.col(e).alias("id"), "edge_type") for e in ends]
    both = sides[0] if len(sides) == 1 else sides[0].unionAll(sides[1])
    return both.groupBy("id", "edge_type").agg(F.count("*").alias("degree"))


def _entry_point(properties: Column) -> Column:
    marks = F.from_json(F.get_json_object(properties, "$.annotations"), "array<string>")
    return F.coalesce(F.exists(marks, lambda a: F.lower(a).isin(ENTRY_ANNOTATIONS)), F.lit(False))


def search_nodes(
    graph: PropertyGraph,
    project_id: int,
    *,
    labels: str | list[str] | None = None,
    name_pattern: str | None = None,
    qualified_name_pattern: str | None = None,
    file_glob: str | None = None,
    properties: dict | None = None,
    degree: Degree | None = None,
    exclude_entry_points: bool = False,
    counts: DataFrame | None = None,
    names: NameIndex | None = None,
) -> DataFrame:
    """The nodes that pass every filter given. Patterns match anywhere, without regard to case. With ``counts`` (see
    ``counts.py``) degrees are read, not counted from edges; with ``names``, the project's index of the column that a
    pattern is for, only names that hold the pattern's trigrams are tried."""
    out = graph.project_nodes(project_id)
    pattern = {"name": name_pattern, "qualified_name": qualified_name_pattern}.get(names.column) if names else None
    if pattern:
        out = names.matching(pattern)
    if labels:
        out = out.where(F.col("label").isin([labels] if isinstance(labels, str) else list(labels)))
    for column, pattern in (("name", name_pattern), ("qualified_name", qualified_name_pattern)):
        if pattern:
            out = out.where(F.col(column).rlike(ignore_case(pattern)))
    if file_glob:
        out = out.where(F.col("file_path").rlike(glob_pattern(file_glob)))
    for name, wanted in (properties or {}).items():
        out = out.where(property_is(F.col("properties"), name, wanted))
    if exclude_entry_points:
        out = out.where(~_entry_point(F.col("properties")))
    if degree:
        of = degrees(graph, project_id, degree.edge_type, degree.direction) if counts is None else kept_counts.degrees(counts, project_id, degree.edge_type, degree.direction)
        found = of.select("id", F.col("degree").alias("_degree"))
        # a minimum of one needs no row for nodes without edges
        out = out.join(found, "id", "inner" if degree.floor > 0 else "left")
        found = F.coalesce("_degree", F.lit(0))
        out = out.where(found >= degree.floor)
        if degree.most is not None:
            out = out.where(found <= degree.most)
        out = out.drop("_degree")
    return out


def page_of(found: DataFrame, limit: int = DEFAULT_ROWS, offset: int = 0, detail: str = "compact") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order of id."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS} and offset not negative")
    columns = list(COMPACT) if detail == "compact" else [c for c in found.columns if not c.startswith("p_")]
    return found.select(*columns).orderBy("id").offset(offset).limit(limit)


def search_page(graph: PropertyGraph, project_id: int, *, limit: int = DEFAULT_ROWS, offset: int = 0, detail: str = "compact", **filters) -> dict:
    """One page with ``has_more`` and ``next_offset``, found by looking one row ahead."""
    page_of(graph.nodes, limit, offset)  # validates
    rows = search_nodes(graph, project_id, **filters).select(*(COMPACT if detail == "compact" else [c for c in graph.nodes.columns if not c.startswith("p_")])).orderBy("id").offset(offset).limit(limit + 1).collect()
    more = len(rows) > limit
    return {"results": [r.asDict(True) for r in rows[:limit]], "has_more": more, "next_offset": offset + limit if more else None}
