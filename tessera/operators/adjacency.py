"""Tables sorted and bucketed by a key, of which a look-up reads the buckets it needs; and a graph's adjacency in them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.staging import temporary_folder

#: Rows of a bucket; beyond MOST_BUCKETS buckets they grow instead, so that their ranges (24 bytes each) stay small.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 65_536


@dataclass(frozen=True)
class RangeStore:
    """Rows in folders ``bucket=<n>`` by ranges of ``key``; a key with very many rows spans several buckets.

    ``bucket``, ``low`` and ``high`` are the buckets that hold rows and the keys they begin and end with, ascending.
    """

    table: DataFrame
    key: str
    bucket: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def build(df: DataFrame, key: str, tie: str, path: str, rows: int | None = None) -> RangeStore:
        """Writes ``df`` to ``path``: one shuffle by ranges of (``key``, ``tie``), which are sampled from all rows."""
        spark = df.sparkSession
        n = df.count()
        buckets = min(MOST_BUCKETS, max(1, -(-n // (rows or BUCKET_ROWS))))
        dealt = df.where(F.col(key).isNotNull()).repartitionByRange(buckets, key, tie).withColumn("bucket", F.spark_partition_id())
        dealt.sortWithinPartitions("bucket", key, tie).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/rows")
        ends = spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("bucket").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return RangeStore.open(spark, path, key, dealt.schema)

    @staticmethod
    def open(spark: SparkSession, path: str, key: str, schema=None) -> RangeStore:
        ends = spark.read.schema("bucket int, low long, high long").parquet(f"{path}/ranges").orderBy("low", "high", "bucket").toArrow()
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return RangeStore(reader.parquet(f"{path}/rows"), key, *(ends.column(c).to_numpy() for c in ("bucket", "low", "high")))

    def buckets_of(self, ids: DataFrame) -> list[int]:
        """Buckets that may hold a key of the ``id`` column: tasks mark them, so that only bucket numbers are collected."""
        low, high, bucket = self.low, self.high, self.bucket

        def run(batches):
            marks = np.zeros(len(low) + 1, np.int64)
            for b in batches:
                keys = b.column("id").drop_null().to_numpy()
                first, past = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
                met = past > first
                np.add.at(marks, first[met], 1)
                np.add.at(marks, past[met], -1)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[np.cumsum(marks)[:-1] > 0], pa.int32())], names=["bucket"])

        return sorted(r["bucket"] for r in ids.select(F.col("id").cast("long").alias("id")).mapInArrow(run, "bucket int").distinct().collect())

    def read(self, buckets: list[int]) -> DataFrame:
        """The rows of these buckets; no other folder is listed in the scan."""
        if len(buckets) == len(self.bucket):
            return self.table.drop("bucket")
        return self.table.where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The rows whose key is in the ``id`` column of ``ids``, once for each of its rows, with its other columns."""
        return self.read(self.buckets_of(ids)).join(ids.withColumnRenamed("id", self.key), self.key)


@dataclass(frozen=True)
class Adjacency:
    """One project's nodes and edges by id, and its half-edges by the node they hang at.

    A half-edge is (near, way, far, edge_id, edge_type, confidence, known): way 0 leaves ``near`` and 1 enters it;
    ``known`` tells that ``far`` is a node of the project.
    """

    nodes: RangeStore
    edges: RangeStore
    halves: RangeStore

    @staticmethod
    def build(graph: PropertyGraph, project_id: int, path: str | None = None, rows: int | None = None) -> Adjacency:
        path = path or temporary_folder(graph.spark, "adjacency")
        nodes = RangeStore.build(graph.project_nodes(project_id), "id", "label", f"{path}/nodes", rows)
        edges = RangeStore.build(graph.project_edges(project_id), "id", "edge_type", f"{path}/edges", rows)
        told = edges.table.select("source_id", "target_id", F.col("id").alias("edge_id"), "edge_type", "confidence")
        for end, mark in (("target_id", "_t"), ("source_id", "_s")):
            if graph.trusted:
                told = told.withColumn(mark, F.lit(True))
            else:
                known = nodes.table.select(F.col("id").alias(end), F.lit(True).alias(mark))
                told = told.join(known, end, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
        ways = [F.struct(F.col(near).alias("near"), F.lit(way).cast("tinyint").alias("way"), F.col(far).alias("far"), F.col(mark).alias("known")) for way, near, far, mark in ((0, "source_id", "target_id", "_t"), (1, "target_id", "source_id", "_s"))]
        halves = told.select(F.explode(F.array(*ways)).alias("h"), "edge_id", "edge_type", "confidence").select("h.*", "edge_id", "edge_type", "confidence")
        return Adjacency(nodes, edges, RangeStore.build(halves, "near", "edge_id", f"{path}/halves", rows))

    @staticmethod
    def open(spark: SparkSession, path: str) -> Adjacency:
        return Adjacency(*(RangeStore.open(spark, f"{path}/{name}", key) for name, key in (("nodes", "id"), ("edges", "id"), ("halves", "near"))))
