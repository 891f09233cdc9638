"""Which references a change of files can affect: symbols that nodes offer, and symbols that references look up.

A symbol is a text with a kind: ``x`` a node by label and whole name, ``t`` a type by either name, ``m`` a method by its
own name, ``c`` a method by its class and own name, ``f`` a field by its own name, ``r`` a relationship, ``o`` any object. A reference's edges depend on the nodes
alone that share a symbol with it, and on nothing of them but their ``meaning``; so after a change only references that
share a symbol with a node that came, went or changed its meaning can resolve otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions of the reverse index by hash of the symbol: a run reads those of the symbols that changed.
BUCKETS = 64


def bucket(key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def _prop(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def up_relation() -> Column:
    """Name by which a look-up field's record is reached."""
    return F.when(F.col("name").endswith("__c"), F.regexp_replace("name", "__c$", "__r")).otherwise(F.regexp_replace("name", "Id$", ""))


def down_relation() -> Column:
    """Name by which the records that look up are reached from the object."""
    children = _prop("relationshipName")
    return F.when(F.col("name").endswith("__c"), F.concat(children, F.lit("__r"))).otherwise(children)


def meaning() -> Column:
    """What of a node references can depend on, besides label and whole name."""
    return F.struct("id", "name", *[_prop(p).alias(p) for p in ("ownerClass", "arity", "isAuraEnabled", "referenceTo", "relationshipName")])


def symbols_of(nodes: DataFrame) -> DataFrame:
    """``key`` of every symbol the nodes offer; distinct."""
    label, low = F.col("label"), lambda c: F.lower(F.col(c))
    is_field, is_type = label == "Field", label.isin("ApexClass", "ApexInterface")
    own = F.array(
        _key("x", label, F.col("qualified_name")),
        F.when(is_type, _key("t", low("name"))), F.when(is_type, _key("t", low("qualified_name"))), F.when(label == "ApexMethod", _key("m", low("name"))),
        F.when(label == "ApexMethod", _key("c", F.lower(_prop("ownerClass")), low("name"))), F.when(label == "ApexMethod", _key("c", F.lower(F.regexp_extract(_prop("ownerClass"), r"([^.]+)$", 1)), low("name"))),
        F.when(is_field, _key("f", F.lower(F.regexp_extract("qualified_name", r"([^.]+)$", 1)))), F.when(is_field & _prop("referenceTo").isNotNull(), _key("r", F.lower(up_relation()))),
        F.when(is_field & down_relation().isNotNull(), _key("r", F.lower(down_relation()))), F.when(label == "SObject", F.lit("o|")),
    )
    return nodes.select(F.explode(own).alias("key")).where("key is not null").distinct()


def symbols_in(records: DataFrame) -> DataFrame:
    """(rec_id, file_path, key) of every symbol that an edge or reference record looks up."""
    ref, text = F.col("ref"), F.col("text")
    last = F.lower(F.regexp_extract(text, r"([^.]+)$", 1))
    of = F.lower(F.regexp_extract(text, r"^(?:(.*)\.)?[^.]+$", 1))
    query = ref.isin("soql", "soql_object")
    sides = F.split(text, r"\|")
    steps = F.concat(F.slice(F.split(sides[0], ">"), 2, 1_000_000), F.when(ref == "soql", F.split(sides[1], r"\.")).otherwise(F.array().cast("array<string>")))
    own = F.concat(
        F.array(_key("x", F.col("label"), F.col("qualified_name"))),
        F.when(F.col("rec") == "edge", F.array(_key("x", F.col("t_label"), F.col("t_name")))).otherwise(F.array().cast("array<string>")),
        F.when(ref.isin("extends", "implements", "new"), F.array(_key("t", F.lower(text))))
        .when(ref == "call", F.array(_key("c", F.when(of.isin("", "this"), F.lower("owner")).otherwise(of), last), _key("t", of)))
        .when(ref == "apex", F.array(_key("m", last)))
        .when(query, F.concat(F.array(F.when(ref == "soql", _key("f", F.lower(F.element_at(F.split(sides[1], r"\."), -1)))).otherwise(F.lit("o|"))), F.transform(steps, lambda s: _key("r", F.lower(s)))))
        .otherwise(F.array().cast("array<string>")),
    )
    return records.where("rec in ('edge', 'ref')").select("rec_id", "file_path", F.explode(F.array_distinct(own)).alias("key"))


def changed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key`` of the symbols of nodes that came, went or changed their meaning."""
    name = ["label", "qualified_name"]
    old, new = (n.select(*name, meaning().alias(k)) for n, k in ((before, "_old"), (after, "_new")))
    differ = old.join(new, name, "full_outer").where("not (_old <=> _new)").select(*name)
    return symbols_of(before.select(*after.columns).unionByName(after).join(differ, name, "left_semi"))


def affected(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``rec_id`` of the references that look up one of ``keys``, from the partitions of the reverse index (bucket, key,
    rec_id) that hold these keys."""
    told = keys.withColumn("bucket", bucket())
    parts = [r["bucket"] for r in told.select("bucket").distinct().collect()]
    if not parts:
        return index.where("false").select("rec_id")
    there = index if len(parts) == BUCKETS else index.where(F.col("bucket").isin(parts))
    return there.join(told, ["bucket", "key"], "left_semi").select("rec_id").distinct()
