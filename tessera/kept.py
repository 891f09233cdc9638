"""What is derived from tables once and used by many queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from tessera.staging import file_versions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
_KEPT: dict[tuple, Any] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept for this application for as long as the tables' files stay as they are."""
    app = spark.sparkContext.applicationId
    key = (app, what, sf_dir, file_versions(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[:3] == key[:3] or k[0] != app]:  # changed files, ended applications
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]
