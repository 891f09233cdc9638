"""Joins that turn names into nodes: changed files, symbols, fallbacks, overloads, relationship paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import AMBIGUOUS, RESOLVED


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (file_path, content_hash, ...) whose content isn't the known one."""
    return found.join(known.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti").select(*found.columns)


def removed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(found.select("file_path"), "file_path", "left_anti").select("file_path")


def symbols(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """name (lower case) -> id, label and qualified_name; of equal names the highest id stands."""
    some = nodes.where(F.col("label").isin(labels))
    pick = F.max(F.struct("id", "label", "qualified_name")).alias("s")
    return some.groupBy(F.lower("name").alias("name"), "project_id").agg(pick).select("name", "project_id", "s.*")


def first_found(refs: DataFrame, ref_key: list[str], candidates: list[DataFrame]) -> DataFrame:
    """For every reference the target of the first candidate list that has one; of several there the smallest id.
    Candidates have the reference's key and ``target_id``."""
    ranked = None
    for priority, c in enumerate(candidates):
        part = c.select(*ref_key, F.struct(F.lit(priority).alias("priority"), F.col("target_id").cast("long").alias("target_id")).alias("_c"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(*ref_key).agg(F.min("_c").alias("_c")).select(*ref_key, F.col("_c.target_id").alias("target_id"))
    return refs.join(best, ref_key)


def best_overload(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Chooses among targets of one ``name`` by ``arity``: the only one of that arity is sure; of several the first, or
    else one without parameters, or else the first, each ambiguous. First: the smallest target_id.

    Refs have ref_id, name and arity; targets name, arity and target_id. Two aggregates, no window: targets are combined
    to one row a name and arity before the join, so a name with many targets adds no rows to it.
    """
    key = ["ref_id", "name", "arity"]
    heads = targets.groupBy("name", F.col("arity").alias("_a")).agg(F.min("target_id").alias("target_id"), F.count("*").alias("_n"))
    met = refs.select(*key).join(heads, "name")
    exact = F.col("_a") == F.col("arity")
    rank = F.when(exact, 0).when(F.col("_a") == 0, 1).otherwise(2)
    best = met.groupBy(*key).agg(F.min(F.struct(rank.alias("r"), "target_id")).alias("b"), F.sum(F.when(exact, F.col("_n")).otherwise(0)).alias("n"))
    return best.select(*key, F.col("b.target_id").alias("target_id"), F.when(F.col("n") == 1, RESOLVED).otherwise(AMBIGUOUS).alias("confidence"))


def relationship_paths(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """Follows dotted relationship paths from a start object, a step a join, only where a step is unambiguous; as many
    steps as the longest path has.

    ``paths``: path_id, object, steps (array of relation names). ``relations``: object, relation, target.
    Returns path_id and object, the object at the end, for the paths that resolve whole.
    """
    unique = relations.groupBy(F.lower("object").alias("object"), F.lower("relation").alias("relation")).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).where("n = 1")
    now = paths.select("path_id", "object", "steps")
    done = now.where(F.size("steps") == 0).select("path_id", "object")
    for _ in range(paths.agg(F.max(F.size("steps"))).first()[0] or 0):
        ahead = now.where(F.size("steps") > 0).select("path_id", F.lower("object").alias("object"), F.lower(F.get("steps", F.lit(0))).alias("relation"), F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))).alias("steps"))
        now = ahead.join(unique, ["object", "relation"]).select("path_id", F.col("target").alias("object"), "steps")
        done = done.unionByName(now.where(F.size("steps") == 0).select("path_id", "object"))
    return done
