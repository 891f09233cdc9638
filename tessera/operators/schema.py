"""Summaries of stored graphs: histograms, samples, project list, file back-references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.counts import histogram

SAMPLES = 5


def node_counts(graph: PropertyGraph, project_id: int) -> DataFrame:
    return graph.project_nodes(project_id).groupBy("label").agg(F.count("*").alias("count"))


def edge_counts(graph: PropertyGraph, project_id: int) -> DataFrame:
    return graph.project_edges(project_id).groupBy("edge_type").agg(F.count("*").alias("count"))


def label_samples(graph: PropertyGraph, project_id: int, most: int = SAMPLES) -> DataFrame:
    """label, rank, id and qualified_name of the first nodes of each label by id. The rank filter is pushed below the
    shuffle, so each task passes on ``most`` rows a label."""
    rank = F.expr("row_number() over (partition by label order by id)")
    return graph.project_nodes(project_id).select("label", "id", "qualified_name", rank.alias("rank")).where(F.col("rank") <= most)


def project_list(graph: PropertyGraph) -> DataFrame:
    """Every project with the numbers of its nodes and edges, zeros included."""
    n = graph.nodes.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("node_count"))
    e = graph.edges.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("edge_count"))
    out = graph.projects.join(n, "id", "left").join(e, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("node_count", "edge_count")})


def schema_summary(graph: PropertyGraph, project_id: int, counts: DataFrame | None = None) -> dict:
    """With ``counts`` (see ``counts.py``) the histograms are read, not counted anew."""
    project = graph.projects.where(F.col("id") == project_id).first()
    if project is None:
        raise ValueError(f"Unknown project {project_id}")
    samples: dict[str, list[str]] = {}
    for r in label_samples(graph, project_id).orderBy("label", "rank").collect():
        samples.setdefault(r["label"], []).append(r["qualified_name"])
    labels = node_counts(graph, project_id) if counts is None else histogram(counts, project_id, "label")
    types = edge_counts(graph, project_id) if counts is None else histogram(counts, project_id, "type")
    return {
        "project_id": project_id,
        "api_version": project["api_version"],
        "indexed_at": project["indexed_at"],
        "nodes": {r["label"]: {"count": r["count"], "samples": samples.get(r["label"], [])} for r in labels.collect()},
        "edges": {r["edge_type"]: r["count"] for r in types.collect()},
    }


def reverse_index(graph: PropertyGraph, project_id: int) -> DataFrame:
    """(target_file, referring_file): files of which one has an edge into the other."""
    files = graph.project_nodes(project_id).where("file_path is not null").select("id", "file_path")
    ends = graph.project_edges(project_id).select("source_id", "target_id")
    # pairs of files are few beside edges: count sides down to distinct (source, target file) before the second join
    to = ends.join(files.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file")), "target_id").select("source_id", "target_file").distinct()
    pairs = to.join(files.select(F.col("id").alias("source_id"), F.col("file_path").alias("referring_file")), "source_id")
    return pairs.where("target_file != referring_file").select("target_file", "referring_file").distinct()
