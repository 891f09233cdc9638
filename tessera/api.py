"""The ten tools, each a method that takes plain values and gives plain ones."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tessera.operators import diff, reports, schema, search, snippet, trace
from tessera.operators.adjacency import Adjacency
from tessera.operators.pages import Pages
from tessera.plans.compiler import compile_query
from tessera.plans.errors import CypherError
from tessera.streaming.ingest import Index, index_into, index_project


class Engine:
    """An index and the questions that can be put to it."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark, self.store = spark, store
        self.index = Index.load(spark, store) if store else Index.empty(spark)
        self._near: dict[int, Adjacency] = {}

    @property
    def graph(self):
        return self.index.graph

    def index_project(self, project_root: str, mode: str = "incremental") -> dict:
        """The run's counts. With a store, other writers' versions are built upon, never written over."""
        if self.store:
            self.index, counts = index_into(self.spark, self.store, project_root, mode, self.index)
        else:
            self.index, counts = index_project(self.index, project_root, mode)
        self._near.clear()
        return counts

    def list_projects(self) -> list[dict]:
        return [r.asDict() for r in schema.project_list(self.graph).orderBy("id").collect()]

    def get_schema(self, project_id: int) -> dict:
        return schema.schema_summary(self.graph, project_id, self.index.counts)

    def search_graph(self, project_id: int, **filters) -> dict:
        return search.search_page(self.graph, project_id, counts=self.index.counts, **filters)

    def trace_references(self, project_id: int, qualified_name: str, **how) -> dict:
        if project_id not in self._near:
            self._near[project_id] = Adjacency.build(self.graph, project_id)
        nodes, edges = trace.trace(self.graph, project_id, qualified_name, adjacency=self._near[project_id], **how)
        return {"nodes": [r.asDict() for r in nodes.orderBy("depth", "id").collect()], "edges": [r.asDict() for r in edges.orderBy("depth", "id").collect()]}

    def get_source_snippet(self, project_id: int, qualified_name: str, context_lines: int = 0) -> dict:
        return snippet.source_snippet(self.graph, project_id, qualified_name, context_lines)

    def get_field_usage(self, project_id: int, field: str, include_indirect: bool = True) -> dict:
        return reports.field_report(self.graph, project_id, field, include_indirect)

    def get_permission_access(self, project_id: int, target_type: str, qualified_name: str) -> dict:
        return reports.access_report(self.graph, project_id, target_type, qualified_name)

    def query_graph(self, project_id: int, text: str) -> dict:
        """Columns, rows and warnings; an error says what to change."""
        try:
            result = compile_query(self.graph, project_id, text)
        except CypherError as e:
            return {"error": str(e), "suggestion": e.suggestion}
        try:
            rows = [[c.asDict() if hasattr(c, "asDict") else c for c in r] for r in result.frame.collect()]
        except PySparkException as e:
            return {"error": f"the query failed: {str(e).splitlines()[0]}", "suggestion": "ask for fewer rows, or for one label or edge type at a time"}
        return {"columns": result.columns, "rows": rows, "row_count": len(rows), "warnings": result.warnings}

    def open_query(self, project_id: int, text: str) -> Pages:
        """The rows of a query in its own order, stored once: any page of them is a seek. For answers too large to be
        given whole; raises on what is no query."""
        return Pages.build(compile_query(self.graph, project_id, text).frame, [])

    def diff_projects(self, base: int, target: int, include_source: bool = True, limit: int = 50, offset: int = 0) -> dict:
        found = diff.changes(self.graph, base, target, include_source).persist()
        try:
            counts = {r["change"]: r["count"] for r in diff.summary(found).collect()}
            page = [r.asDict() for r in diff.page(found, limit, offset).collect()]
        finally:
            found.unpersist()
        total = sum(counts.values())
        return {"summary": {k: counts.get(k, 0) for k in ("added", "removed", "changed")}, "changes": page, "has_more": offset + limit < total}
