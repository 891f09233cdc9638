"""Binds the star-schema, event and document tables to a property graph.

Every label and every edge type is one branch of a union with a literal label or type, so a query that names one reads
that one table. Ids are ``kind * 10^12 + key``; project 2 is a changed snapshot of project 1, its ids 10^15 higher.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.graph import PropertyGraph

KIND = 10**12
SNAPSHOT = 10**15
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, EVENT_TYPE, DOCUMENT, SOURCE = range(1, 11)
IN_REGION, IN_NATION, PLACED, CONTAINS_PART, SUPPLIED_BY, DID, FROM_SOURCE = range(1, 8)

NODE_PROMOTED = {"segment": T.StringType(), "nation": T.IntegerType(), "brand": T.StringType(), "type": T.StringType(), "status": T.StringType(), "priority": T.StringType(), "lang": T.StringType()}
EDGE_PROMOTED = {"flag": T.StringType(), "line": T.IntegerType()}


def _node(df: DataFrame, kind: int, label: str, key: Column, name: Column, qname: Column, path: Column | None = None, props: dict[str, Column] | None = None) -> DataFrame:
    props = props or {}
    text = F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")
    null = F.lit(None)
    return df.select(
        (F.lit(kind * KIND) + key).cast("long").alias("id"), F.lit(1).cast("long").alias("project_id"), F.lit(label).alias("label"), name.alias("name"), qname.alias("qualified_name"),
        (null if path is None else path).cast("string").alias("file_path"), null.cast("int").alias("start_line"), null.cast("int").alias("end_line"), text.alias("properties"),
        null.cast("string").alias("content_hash"), F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"),
        *[(props.get(k, null)).cast(t).alias("p_" + k) for k, t in NODE_PROMOTED.items()],
    )


def _edge(df: DataFrame, code: int, kind: str, key: Column, source: Column, target: Column, confidence: Column | None = None, props: dict[str, Column] | None = None, line: Column | None = None) -> DataFrame:
    props = props or {}
    text = F.to_json(F.struct(*[c.alias(k) for k, c in props.items()])) if props else F.lit("{}")
    null = F.lit(None)
    return df.select(
        (F.lit(code * KIND) + key).cast("long").alias("id"), F.lit(1).cast("long").alias("project_id"), source.cast("long").alias("source_id"), target.cast("long").alias("target_id"),
        F.lit(kind).alias("edge_type"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"), text.alias("properties"), null.cast("string").alias("source_file"),
        (null if line is None else line).cast("int").alias("source_line"),
        *[(props.get(k, null)).cast(t).alias("p_" + k) for k, t in EDGE_PROMOTED.items()],
    )


def _at(kind: int, key: str | Column) -> Column:
    return F.lit(kind * KIND) + (F.col(key) if isinstance(key, str) else key)


def bind_tables(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> PropertyGraph:
    """The graph over the tables in ``sf_dir``; with the changed snapshot as project 2, if wanted."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lit, col = F.lit, F.col
    orders, items = table("orders"), table("lineitem")
    # few distinct values: their ranks are made once and joined
    types = table("events").select("event_type").distinct().select("event_type", F.expr("dense_rank() over (order by event_type)").cast("long").alias("rank"))
    sources = table("documents").select("source").distinct().select("source", F.expr("dense_rank() over (order by source)").cast("long").alias("rank"))
    marks = F.when(col("p_size") % 5 == 0, F.array(lit("AuraEnabled"))).when(col("p_size") % 5 == 1, F.array(lit("IsTest"), lit("x"))).otherwise(F.array().cast("array<string>"))
    nodes = [
        _node(table("region"), REGION, "Region", col("r_regionkey"), col("r_name"), F.concat(lit("REGION#"), "r_regionkey"), lit("geo.tbl")),
        _node(table("nation"), NATION, "Nation", col("n_nationkey"), col("n_name"), F.concat(lit("NATION#"), "n_nationkey"), lit("geo.tbl")),
        _node(table("customer"), CUSTOMER, "Customer", col("c_custkey"), col("c_name"), col("c_name"), F.concat(lit("customer/"), "c_nationkey"), {"segment": col("c_mktsegment"), "nation": col("c_nationkey")}),
        _node(table("supplier"), SUPPLIER, "Supplier", col("s_suppkey"), col("s_name"), col("s_name"), F.concat(lit("supplier/"), "s_nationkey"), {"nation": col("s_nationkey")}),
        _node(table("part"), PART, "Part", col("p_partkey"), col("p_name"), F.concat(lit("Part#"), "p_partkey"), F.concat(lit("part/"), "p_brand"), {"brand": col("p_brand"), "type": col("p_type"), "size": col("p_size"), "annotations": marks}),
        _node(orders, ORDER, "SalesOrder", col("o_orderkey"), F.concat(lit("Order#"), "o_orderkey"), F.concat(lit("Order#"), "o_orderkey"), F.concat(lit("order/"), "o_orderpriority"), {"status": col("o_orderstatus"), "priority": col("o_orderpriority"), "open": col("o_orderstatus") == "O"}),
        _node(table("events").select("user_id").distinct(), USER, "User", col("user_id"), F.concat(lit("User#"), "user_id"), F.concat(lit("User#"), "user_id")),
        _node(types, EVENT_TYPE, "EventType", col("rank"), col("event_type"), col("event_type")),
        _node(table("documents"), DOCUMENT, "Document", col("doc_id"), F.concat(lit("Document#"), "doc_id"), F.concat(lit("Document#"), "doc_id"), None, {"lang": col("lang"), "n_chars": col("n_chars")}),
        _node(sources, SOURCE, "Source", col("rank"), col("source"), col("source")),
    ]
    sure = F.when(col("l_returnflag") == "N", 1.0).when(col("l_returnflag") == "R", 0.6).otherwise(0.4)
    line_props = {"flag": col("l_returnflag"), "line": col("l_linenumber")}
    by_all = ", ".join(items.columns)
    line_key = col("l_orderkey") * 1000 + F.expr(f"row_number() over (partition by l_orderkey order by {by_all})")
    k = F.get_json_object("props", "$.k").cast("int")
    edges = [
        _edge(table("nation"), IN_REGION, "IN_REGION", col("n_nationkey"), _at(NATION, "n_nationkey"), _at(REGION, "n_regionkey")),
        _edge(table("customer"), IN_NATION, "IN_NATION", col("c_custkey"), _at(CUSTOMER, "c_custkey"), _at(NATION, "c_nationkey")),
        _edge(table("supplier"), IN_NATION, "IN_NATION", lit(5 * 10**11) + col("s_suppkey"), _at(SUPPLIER, "s_suppkey"), _at(NATION, "s_nationkey")),
        _edge(orders, PLACED, "PLACED", col("o_orderkey"), _at(CUSTOMER, "o_custkey"), _at(ORDER, "o_orderkey")),
        _edge(items, CONTAINS_PART, "CONTAINS_PART", line_key, _at(ORDER, "l_orderkey"), _at(PART, "l_partkey"), sure, line_props, col("l_linenumber")),
        _edge(items, SUPPLIED_BY, "SUPPLIED_BY", line_key, _at(ORDER, "l_orderkey"), _at(SUPPLIER, "l_suppkey"), sure, line_props, col("l_linenumber")),
        _edge(table("events").join(types, "event_type"), DID, "DID", col("event_id"), _at(USER, "user_id"), _at(EVENT_TYPE, "rank"), None, {"k": k}),
        _edge(table("documents").join(sources, "source"), FROM_SOURCE, "FROM_SOURCE", col("doc_id"), _at(DOCUMENT, "doc_id"), _at(SOURCE, "rank")),
    ]
    projects = spark.range(1, 3 if snapshot else 2).select("id", F.concat(lit("tables/"), "id").alias("root_path"), F.concat(lit("tables"), "id").alias("name"), lit(0).cast("long").alias("indexed_at"), lit(None).cast("string").alias("api_version"))
    if snapshot:
        nodes += [_later_node(n) for n in nodes]
        edges += [_later_edge(e) for e in edges]
    return PropertyGraph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges), projects, node_promoted=NODE_PROMOTED, edge_promoted=EDGE_PROMOTED, trusted=True)


def _later_node(n: DataFrame) -> DataFrame:
    """Project 2: orders with a key divisible by 97 are gone; ``open`` is flipped where it is divisible by 89."""
    key = F.col("id") - ORDER * KIND
    is_order = F.col("label") == "SalesOrder"
    status, was_open = F.col("p_status"), F.col("p_status") == "O"
    flipped = F.to_json(F.struct(status.alias("status"), F.col("p_priority").alias("priority"), (~was_open).alias("open")))
    out = n.where(~(is_order & (key % 97 == 0)))
    return out.withColumns({"properties": F.when(is_order & (key % 89 == 0), flipped).otherwise(F.col("properties")), "id": F.col("id") + SNAPSHOT, "project_id": F.lit(2).cast("long")})


def _later_edge(e: DataFrame) -> DataFrame:
    def gone(end: str) -> Column:
        key = F.col(end) - ORDER * KIND
        return (key >= 0) & (key < KIND) & (key % 97 == 0)

    out = e.where(~(gone("source_id") | gone("target_id")))
    return out.withColumns({c: F.col(c) + SNAPSHOT for c in ("id", "source_id", "target_id")} | {"project_id": F.lit(2).cast("long")})


#: The same graph as DuckDB views' SQL, with properties as columns: n (nodes) and e (edges) of project 1.
ORACLE_PREFIX = """
WITH et AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS rk FROM (SELECT DISTINCT event_type FROM events)),
src AS (SELECT source, dense_rank() OVER (ORDER BY source) AS rk FROM (SELECT DISTINCT source FROM documents)),
n AS (
  SELECT 1000000000000 + r_regionkey AS id, 'Region' AS label, r_name AS name, 'REGION#' || r_regionkey AS qname, 'geo.tbl' AS path,
    NULL::VARCHAR AS segment, NULL::INTEGER AS nation, NULL::VARCHAR AS brand, NULL::VARCHAR AS type, NULL::INTEGER AS size,
    NULL::VARCHAR AS status, NULL::VARCHAR AS priority, NULL::BOOLEAN AS open, NULL::VARCHAR AS lang, NULL::BIGINT AS n_chars FROM region
  UNION ALL BY NAME SELECT 2000000000000 + n_nationkey AS id, 'Nation' AS label, n_name AS name, 'NATION#' || n_nationkey AS qname, 'geo.tbl' AS path FROM nation
  UNION ALL BY NAME SELECT 3000000000000 + c_custkey AS id, 'Customer' AS label, c_name AS name, c_name AS qname, 'customer/' || c_nationkey AS path, c_mktsegment AS segment, c_nationkey AS nation FROM customer
  UNION ALL BY NAME SELECT 4000000000000 + s_suppkey AS id, 'Supplier' AS label, s_name AS name, s_name AS qname, 'supplier/' || s_nationkey AS path, s_nationkey AS nation FROM supplier
  UNION ALL BY NAME SELECT 5000000000000 + p_partkey AS id, 'Part' AS label, p_name AS name, 'Part#' || p_partkey AS qname, 'part/' || p_brand AS path, p_brand AS brand, p_type AS type, p_size AS size FROM part
  UNION ALL BY NAME SELECT 6000000000000 + o_orderkey AS id, 'SalesOrder' AS label, 'Order#' || o_orderkey AS name, 'Order#' || o_orderkey AS qname, 'order/' || o_orderpriority AS path, o_orderstatus AS status, o_orderpriority AS priority, o_orderstatus = 'O' AS open FROM orders
  UNION ALL BY NAME SELECT DISTINCT 7000000000000 + user_id AS id, 'User' AS label, 'User#' || user_id AS name, 'User#' || user_id AS qname FROM events
  UNION ALL BY NAME SELECT 8000000000000 + rk AS id, 'EventType' AS label, event_type AS name, event_type AS qname FROM et
  UNION ALL BY NAME SELECT 9000000000000 + doc_id AS id, 'Document' AS label, 'Document#' || doc_id AS name, 'Document#' || doc_id AS qname, lang, n_chars FROM documents
  UNION ALL BY NAME SELECT 10000000000000 + rk AS id, 'Source' AS label, source AS name, source AS qname FROM src),
li AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k,
  CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN 0.6 ELSE 0.4 END::DOUBLE AS conf FROM lineitem),
e AS (
  SELECT 1000000000000 + n_nationkey AS id, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, 'IN_REGION' AS type, 1.0::DOUBLE AS conf,
    NULL::VARCHAR AS flag, NULL::INTEGER AS line, NULL::INTEGER AS k FROM nation
  UNION ALL BY NAME SELECT 2000000000000 + c_custkey AS id, 3000000000000 + c_custkey AS src, 2000000000000 + c_nationkey AS dst, 'IN_NATION' AS type, 1.0 AS conf FROM customer
  UNION ALL BY NAME SELECT 2500000000000 + s_suppkey AS id, 4000000000000 + s_suppkey AS src, 2000000000000 + s_nationkey AS dst, 'IN_NATION' AS type, 1.0 AS conf FROM supplier
  UNION ALL BY NAME SELECT 3000000000000 + o_orderkey AS id, 3000000000000 + o_custkey AS src, 6000000000000 + o_orderkey AS dst, 'PLACED' AS type, 1.0 AS conf FROM orders
  UNION ALL BY NAME SELECT 4000000000000 + k AS id, 6000000000000 + l_orderkey AS src, 5000000000000 + l_partkey AS dst, 'CONTAINS_PART' AS type, conf, l_returnflag AS flag, l_linenumber AS line FROM li
  UNION ALL BY NAME SELECT 5000000000000 + k AS id, 6000000000000 + l_orderkey AS src, 4000000000000 + l_suppkey AS dst, 'SUPPLIED_BY' AS type, conf, l_returnflag AS flag, l_linenumber AS line FROM li
  UNION ALL BY NAME SELECT 6000000000000 + event_id AS id, 7000000000000 + user_id AS src, 8000000000000 + rk AS dst, 'DID' AS type, 1.0 AS conf, (props->>'$.k')::INTEGER AS k FROM events JOIN et USING (event_type)
  UNION ALL BY NAME SELECT 7000000000000 + doc_id AS id, 9000000000000 + doc_id AS src, 10000000000000 + rk AS dst, 'FROM_SOURCE' AS type, 1.0 AS conf FROM documents JOIN src USING (source))
"""
