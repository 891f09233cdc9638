"""A property graph as DataFrames, with its write operations as pure functions from graph to graph."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import model
from tessera.staging import stage

_TABLES = ("projects", "nodes", "edges", "file_hashes", "file_backrefs")


class SchemaVersionError(RuntimeError):
    """A stored graph was written by a newer version."""


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class PropertyGraph:
    """``promoted``: properties that are columns ``p_<name>`` of nodes or edges beside their JSON, so that filters on
    them reach the scan. ``trusted``: every edge's ends are nodes of the edge's own project."""

    nodes: DataFrame
    edges: DataFrame
    projects: DataFrame
    file_hashes: DataFrame | None = None
    file_backrefs: DataFrame | None = None
    node_promoted: dict[str, T.DataType] = field(default_factory=dict)
    edge_promoted: dict[str, T.DataType] = field(default_factory=dict)
    trusted: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> PropertyGraph:
        made = {t: spark.createDataFrame([], getattr(model, t.upper())) for t in _TABLES}
        return PropertyGraph(made["nodes"], made["edges"], made["projects"], made["file_hashes"], made["file_backrefs"])

    # reading and writing

    def save(self, path: str) -> None:
        """Parquet: nodes by project and label, edges by project and type, so that scans prune."""
        meta = self.spark.createDataFrame([(model.SCHEMA_VERSION,)], "schema_version int")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta.parquet")
        for name, by in (("nodes", ["project_id", "label"]), ("edges", ["project_id", "edge_type"]), ("projects", []), ("file_hashes", ["project_id"]), ("file_backrefs", ["project_id"])):
            table = getattr(self, name)
            if table is None:
                table = self.spark.createDataFrame([], getattr(model, name.upper()))
            table.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}.parquet")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        found = spark.read.parquet(f"{path}/_meta.parquet").first()["schema_version"]
        if found > model.SCHEMA_VERSION:
            raise SchemaVersionError(f"graph has schema version {found}; this library reads up to {model.SCHEMA_VERSION}")
        read = {t: spark.read.schema(getattr(model, t.upper())).parquet(f"{path}/{t}.parquet") for t in _TABLES}
        return PropertyGraph(**read)

    # scans

    def project_nodes(self, project_id: int) -> DataFrame:
        return self.nodes.where(F.col("project_id") == project_id)

    def project_edges(self, project_id: int) -> DataFrame:
        return self.edges.where(F.col("project_id") == project_id)

    def node_by_name(self, project_id: int, label: str, qualified_name: str) -> DataFrame:
        return self.project_nodes(project_id).where((F.col("label") == label) & (F.col("qualified_name") == qualified_name))

    def nodes_by_id(self, ids: DataFrame) -> DataFrame:
        """Nodes whose id is in the ``id`` column of ``ids``, of any project."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    # writes

    def upsert_project(self, root_path: str, name: str, api_version: str | None = None) -> tuple[PropertyGraph, int]:
        """The graph with the project of that root path, and its id; the name and version follow the last call."""
        known = self.projects.where(F.col("root_path") == root_path).first()
        new_id = known["id"] if known else (self.projects.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(new_id, root_path, name, known["indexed_at"] if known else None, api_version)], model.PROJECTS)
        return replace(self, projects=self.projects.where(F.col("root_path") != root_path).unionByName(row)), new_id

    def mark_indexed(self, project_id: int, at: int | None = None) -> PropertyGraph:
        stamp = F.when(F.col("id") == project_id, F.lit(at or now_ms())).otherwise(F.col("indexed_at"))
        return replace(self, projects=self.projects.withColumn("indexed_at", stamp))

    def upsert_nodes(self, incoming: DataFrame, at: int | None = None, above: int = 0) -> PropertyGraph:
        """Merges nodes on (project_id, label, qualified_name): a known one keeps id and creation time and takes the
        rest; new ones get ids above the largest, and above ``above``, in order of their key. ``incoming`` needs no id."""
        at = at or now_ms()
        key = ["project_id", "label", "qualified_name"]
        rest = ["name", "file_path", "start_line", "end_line", "properties", "content_hash"]
        new = incoming.select(*key, *rest, F.lit(True).alias("_new"))
        old = self.nodes.select(*model.NODES.fieldNames())
        both = old.join(new.select(*key, *[F.col(c).alias("n_" + c) for c in rest], "_new"), key, "full_outer")
        top = old.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(above)).alias("_top"))
        fresh = number_rows(both.where("id is null"), [F.col(k) for k in key], "_nth").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_nth")).drop("_nth", "_top")
        merged = both.where("id is not null").unionByName(fresh)
        picked = [F.when(F.col("_new"), F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in rest]
        out = merged.select("id", *key, *picked, F.coalesce("created_at", F.lit(at)).alias("created_at"), F.when(F.col("_new"), F.lit(at)).otherwise(F.col("updated_at")).alias("updated_at"))
        return replace(self, nodes=out.select(*[F.col(f.name).cast(f.dataType) for f in model.NODES]), node_promoted={})

    def append_edges(self, incoming: DataFrame) -> PropertyGraph:
        """Adds edges, parallel ones included; confidence defaults to 1.0 and properties to an empty object."""
        top = self.edges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
        have = incoming.columns
        filled = incoming.withColumns({
            "confidence": F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in have else F.lit(1.0),
            "properties": F.coalesce(F.col("properties"), F.lit("{}")) if "properties" in have else F.lit("{}"),
            "source_file": F.col("source_file") if "source_file" in have else F.lit(None).cast("string"),
            "source_line": F.col("source_line") if "source_line" in have else F.lit(None).cast("int"),
        })
        order = [F.col(c) for c in ("project_id", "source_id", "target_id", "edge_type", "source_line", "properties")]
        numbered = number_rows(filled, order, "_nth").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_nth"))
        cols = [F.col(f.name).cast(f.dataType) for f in model.EDGES]
        return replace(self, edges=self.edges.select(*model.EDGES.fieldNames()).unionByName(numbered.select(*cols)), edge_promoted={})

    def delete_files(self, project_id: int, paths: DataFrame) -> PropertyGraph:
        """Without the nodes of these files (column ``file_path``) and every edge that starts or ends at one."""
        gone = self.project_nodes(project_id).join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
        edges = self.edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return replace(self, nodes=self.nodes.join(gone, "id", "left_anti"), edges=edges.select(*self.edges.columns))

    def invalid_edges(self) -> DataFrame:
        """Edges of which an end is missing or lies in another project."""
        ends = self.nodes.select("id", F.col("project_id").alias("_p"))
        out = self.edges
        for end in ("source_id", "target_id"):
            out = out.join(ends.select(F.col("id").alias(end), F.col("_p").alias(f"_p_{end}")), end, "left")
        bad = F.lit(False)
        for end in ("source_id", "target_id"):
            bad = bad | ~F.col(f"_p_{end}").eqNullSafe(F.col("project_id"))
        return out.where(bad).select(*self.edges.columns)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with row numbers from 1 in a total order, without gathering the rows: rows are range-partitioned by the
    order and sorted there, and each partition starts from the counts of those before it."""
    keyed = df.withColumn("_o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    sorted_ = keyed.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_place", F.monotonically_increasing_id())  # partition, then place
    placed = stage(sorted_.select(*df.columns, F.shiftright("_place", 33).alias("_pid"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))  # once: ranges are sampled
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select("_pid", F.expr("coalesce(sum(_n) over (order by _pid rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return placed.join(F.broadcast(before), "_pid").withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_pid", "_place", "_before")
