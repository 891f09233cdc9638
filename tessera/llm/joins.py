"""Joins that hot keys do not hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: A key with more rows than this, and than one HEAVY_SHARE-th of all rows, is hot; so there are HEAVY_SHARE hot keys at most.
HEAVY_ROWS, HEAVY_SHARE = 1_000, 20_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, by ``keys`` ("inner" or "left"; null keys match nothing).

    Rows of hot keys are joined where they lie, by a broadcast of the right rows of those keys, HEAVY_SHARE at most
    whatever the size of the tables; the others are shuffled, and no key among them holds more than a HEAVY_SHARE-th of
    all rows or HEAVY_ROWS rows. ``left`` is read twice, so it should be a stored table.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(f"_n > {HEAVY_ROWS}")
    known = [F.col(k).isNotNull() for k in keys]
    for k in known:
        counts = counts.where(k)
    hot = counts.select(*keys, "_n").crossJoin(F.broadcast(left.agg(F.count("*").alias("_all")))).where(f"_n > _all / {HEAVY_SHARE}").select(*keys, F.lit(True).alias("_hot"))
    hot = stage(hot)
    if hot.isEmpty():
        return left.join(right, keys, how)
    told = left.join(F.broadcast(hot), keys, "left")
    of_hot = right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    rest = told.where("_hot is null").drop("_hot").join(right, keys, how)
    return rest.unionByName(told.where("_hot").drop("_hot").join(F.broadcast(of_hot), keys, how))
