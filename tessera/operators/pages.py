"""Results put in order once, of which every page is a seek; and nodes by their natural key."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph, number_rows
from tessera.operators.adjacency import RangeStore
from tessera.staging import drop_stage, stage, temporary_folder


@dataclass(frozen=True)
class Pages:
    """Rows by their place (from 1) in a total order. Page n reads the buckets that hold its places, whatever n is."""

    rows: RangeStore

    @staticmethod
    def build(df: DataFrame, order: list[Column], path: str | None = None, rows: int | None = None) -> Pages:
        """Places go by ``order``, ties by the order that ``df`` has already; all pages share it. No task holds more
        than a range of the rows, however many are tied."""
        here = F.monotonically_increasing_id()  # follows the partitions, and so the order
        ordered = df.withColumn("_was", here).orderBy(*order, "_was").drop("_was") if order else df
        made = stage(ordered.withColumn("_at", here))  # stored, so that a task run again finds the same
        placed = number_rows(made, [F.col("_at")], "place").drop("_at")
        out = Pages(RangeStore.build(placed, "place", "place", path or temporary_folder(df.sparkSession, "pages"), rows))
        drop_stage(made)
        return out

    @property
    def total(self) -> int:
        return int(self.rows.high[-1]) if len(self.rows.high) else 0

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order, with their place."""
        if offset < 0 or limit < 1:
            raise ValueError("offset must not be negative and limit at least 1")
        held = self.rows.bucket[(self.rows.low <= offset + limit) & (self.rows.high > offset)]
        return self.rows.read([int(b) for b in np.sort(held)]).where(F.col("place").between(offset + 1, offset + limit)).orderBy("place")


def _natural(label: Column, qualified_name: Column) -> Column:
    return F.xxhash64(label, qualified_name)


@dataclass(frozen=True)
class NodeKeys:
    """A project's nodes in ranges of a hash of their natural key: a look-up of few keys reads few buckets, and of a
    bucket, sorted by the hash, the row groups that may hold them."""

    table: RangeStore

    @staticmethod
    def build(graph: PropertyGraph, project_id: int, path: str | None = None, rows: int | None = None) -> NodeKeys:
        keyed = graph.project_nodes(project_id).withColumn("_key", _natural(F.col("label"), F.col("qualified_name")))
        return NodeKeys(RangeStore.build(keyed, "_key", "id", path or temporary_folder(graph.spark, "keys"), rows))

    def find(self, wanted: DataFrame) -> DataFrame:
        """The nodes whose (label, qualified_name) is in ``wanted``, once each. Equal hashes are told apart."""
        keys = wanted.select("label", "qualified_name").distinct()
        names = keys.select(_natural(F.col("label"), F.col("qualified_name")).alias("id"), F.col("label").alias("_l"), F.col("qualified_name").alias("_q"))
        met = self.table.fetch(names).where((F.col("label") == F.col("_l")) & (F.col("qualified_name") == F.col("_q")))
        return met.drop("_key", "_l", "_q")

    def one(self, label: str, qualified_name: str) -> DataFrame:
        """The node of that natural key, or no row; its hash is a constant filter on one bucket."""
        spark = self.table.table.sparkSession
        key = spark.range(1).select(_natural(F.lit(label), F.lit(qualified_name)).alias("id"))
        some = self.table.read(self.table.buckets_of(key)).where(F.col("_key") == key.first()["id"])
        return some.where((F.col("label") == label) & (F.col("qualified_name") == qualified_name)).drop("_key")
