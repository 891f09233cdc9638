"""Lines of source around a node."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.values import ignore_case
from tessera.graph import PropertyGraph


def source_snippet(graph: PropertyGraph, project_id: int, qualified_name: str, context_lines: int = 0) -> dict:
    """The source lines of the node of that name (case ignored), with ``context_lines`` more on both sides."""
    import re

    project = graph.projects.where(F.col("id") == project_id).first()
    node = graph.project_nodes(project_id).where(F.col("qualified_name").rlike(ignore_case(f"^{re.escape(qualified_name)}$"))).orderBy("id").first()
    if project is None or node is None:
        raise LookupError(f"No node named {qualified_name!r}")
    if not node["file_path"]:
        raise LookupError(f"{qualified_name!r} has no source file")
    try:
        text = graph.spark.read.text(f"{project['root_path'].rstrip('/')}/{node['file_path']}", wholetext=True).first()["value"]
    except Exception as e:
        raise LookupError(f"{node['file_path']!r} can't be read") from e
    lines = text.split("\n")
    first = max(1, (node["start_line"] or 1) - context_lines)
    last = min(len(lines), (node["end_line"] or len(lines)) + context_lines)
    return {"qualified_name": node["qualified_name"], "file_path": node["file_path"], "start_line": first, "end_line": last, "source": "\n".join(lines[first - 1 : last])}
