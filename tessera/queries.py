"""The engine's queries over the bound tables, each with independent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import ingest_queries
from tessera.graph import PropertyGraph
from tessera.kept import once
from tessera.operators import counts, diff, reports, resolve, schema, search, trace
from tessera.operators.adjacency import Adjacency
from tessera.operators.name_index import NameIndex
from tessera.operators.pages import NodeKeys, Pages
from tessera.operators.search import Degree
from tessera.plans.compiler import compile_query
from tessera.sources import tables
from tessera.sources.tables import ORACLE_PREFIX, ORDER, KIND
from tessera.staging import stage

def bind_tables(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> PropertyGraph:
    """The bound graph; its plans are lazy, only file footers are read."""
    return once(spark, sf_dir, f"graph {snapshot}", lambda: tables.bind_tables(spark, sf_dir, snapshot))


def adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The stored adjacency of the bound graph: built once, read by every trace."""
    return once(spark, sf_dir, "adjacency", lambda: Adjacency.build(bind_tables(spark, sf_dir), 1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}



def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, prefix: str = ORACLE_PREFIX) -> None:
    QUERIES[name], ORACLE[name] = run, prefix + sql


def _cypher(name: str, text: str, sql: str) -> None:
    _add("cy_" + name, lambda spark, d: compile_query(bind_tables(spark, d), 1, text).frame, sql)


# projections and filters
_cypher("match_label", "MATCH (c:Customer) RETURN c.name AS name, c.segment AS segment", "SELECT name, segment FROM n WHERE label = 'Customer'")
_cypher("match_all_labels", "MATCH (x) RETURN x.label AS label, count(*) AS c", "SELECT label, count(*) AS c FROM n GROUP BY label")
_cypher("where_eq", "MATCH (c:Customer) WHERE c.segment = 'BUILDING' RETURN c.id AS id", "SELECT id FROM n WHERE label = 'Customer' AND segment = 'BUILDING'")
_cypher("where_in", "MATCH (o:SalesOrder) WHERE o.status IN ['F', 'P'] RETURN o.qualified_name AS q, o.status AS s", "SELECT qname AS q, status AS s FROM n WHERE label = 'SalesOrder' AND status IN ('F', 'P')")
_cypher("where_in_empty", "MATCH (o:SalesOrder) WHERE o.status IN [] RETURN count(*) AS c", "SELECT 0::BIGINT AS c")
_cypher("where_contains", "MATCH (p:Part) WHERE p.name CONTAINS 'a' AND p.type CONTAINS 'E' RETURN p.id AS id, p.name AS name", "SELECT id, name FROM n WHERE label = 'Part' AND contains(name, 'a') AND contains(type, 'E')")
_cypher("where_starts_ends", "MATCH (c:Customer) WHERE c.name STARTS WITH 'C' AND c.name ENDS WITH '7' RETURN c.name AS name", "SELECT name FROM n WHERE label = 'Customer' AND starts_with(name, 'C') AND name LIKE '%7'")
_cypher("where_null", "MATCH (x) WHERE x.segment IS NULL AND x.brand IS NOT NULL RETURN x.label AS label, count(x) AS c", "SELECT label, count(*) AS c FROM n WHERE segment IS NULL AND brand IS NOT NULL GROUP BY label")
_cypher("where_eq_null", "MATCH (x:Part) WHERE x.brand = null RETURN count(*) AS c", "SELECT 0::BIGINT AS c")
_cypher("where_and_or", "MATCH (o:SalesOrder) WHERE (o.status = 'F' OR o.priority STARTS WITH '1') AND o.name ENDS WITH '3' RETURN o.id AS id", "SELECT id FROM n WHERE label = 'SalesOrder' AND (status = 'F' OR starts_with(priority, '1')) AND name LIKE '%3'")
_cypher("bool_property", "MATCH (o:SalesOrder) WHERE o.open = true RETURN o.status AS status, count(*) AS c", "SELECT status, count(*) AS c FROM n WHERE label = 'SalesOrder' AND open GROUP BY status")
_cypher("bool_as_number", "MATCH (o:SalesOrder) WHERE o.open = 1 RETURN o.open AS open, count(*) AS c", "SELECT '1' AS open, count(*) AS c FROM n WHERE label = 'SalesOrder' AND open")
_cypher("numeric_property", "MATCH (p:Part) WHERE p.size = 7 RETURN p.qualified_name AS q", "SELECT qname AS q FROM n WHERE label = 'Part' AND size = 7")
_cypher("numeric_in", "MATCH (d:Document) WHERE d.n_chars IN [100, 200, 300, 400] RETURN d.lang AS lang, count(*) AS c", "SELECT lang, count(*) AS c FROM n WHERE label = 'Document' AND n_chars IN (100, 200, 300, 400) GROUP BY lang")
_cypher("number_is_not_text", "MATCH (p:Part) WHERE p.size = '7' RETURN count(*) AS c", "SELECT 0::BIGINT AS c")
_cypher("order_skip_limit", "MATCH (c:Customer) RETURN c.name AS name ORDER BY c.name DESC SKIP 10 LIMIT 25", "SELECT name FROM n WHERE label = 'Customer' ORDER BY name DESC LIMIT 25 OFFSET 10")
_cypher("order_hidden_key", "MATCH (p:Part) RETURN p.qualified_name AS q ORDER BY p.id LIMIT 17", "SELECT qname AS q FROM n WHERE label = 'Part' ORDER BY id LIMIT 17")
_cypher("distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.type AS type", "SELECT DISTINCT brand, type FROM n WHERE label = 'Part'")

# relationships and joins
_cypher("rel_outgoing", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.name AS customer, n.name AS nation", "SELECT c.name AS customer, x.name AS nation FROM n c JOIN e ON e.src = c.id AND e.type = 'IN_NATION' JOIN n x ON x.id = e.dst WHERE c.label = 'Customer' AND x.label = 'Nation'")
_cypher("rel_incoming", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT x.name AS nation, s.name AS supplier FROM n s JOIN e ON e.src = s.id AND e.type = 'IN_NATION' JOIN n x ON x.id = e.dst WHERE s.label = 'Supplier'")
_cypher("rel_untyped", "MATCH (c:Customer)-[r]->(x) RETURN r.edge_type AS type, x.label AS label, count(*) AS c", "SELECT e.type, x.label, count(*) AS c FROM n c JOIN e ON e.src = c.id JOIN n x ON x.id = e.dst WHERE c.label = 'Customer' GROUP BY ALL")
_cypher("edge_props", "MATCH (o:SalesOrder)-[r:CONTAINS_PART]->(p:Part) WHERE r.flag = 'R' AND r.line = 3 RETURN o.id AS o, p.id AS p, r.confidence AS conf", "SELECT src AS o, dst AS p, conf FROM e WHERE type = 'CONTAINS_PART' AND flag = 'R' AND line = 3")
_cypher("edge_dynamic", "MATCH (u:User)-[d:DID]->(t:EventType) WHERE d.k = 42 RETURN t.name AS type, count(d) AS c", "SELECT x.name AS type, count(*) AS c FROM e JOIN n x ON x.id = e.dst WHERE e.type = 'DID' AND e.k = 42 GROUP BY ALL")
_cypher("two_hop_chain", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) MATCH (c)-[:PLACED]->(o:SalesOrder) RETURN n.name AS nation, o.status AS status, count(*) AS c", "SELECT x.name AS nation, o.status, count(*) AS c FROM e a JOIN n x ON x.id = a.dst JOIN e b ON b.src = a.src AND b.type = 'PLACED' JOIN n o ON o.id = b.dst WHERE a.type = 'IN_NATION' AND a.src < 4000000000000 GROUP BY ALL")
_cypher("cartesian", "MATCH (r:Region) MATCH (t:EventType) RETURN r.name AS region, t.name AS type", "SELECT r.name AS region, t.name AS type FROM n r, n t WHERE r.label = 'Region' AND t.label = 'EventType'")
_cypher("self_loop", "MATCH (x)-[r]->(x) RETURN count(*) AS c", "SELECT count(*) AS c FROM e WHERE src = dst")
_cypher("same_part_twice", "MATCH (o:SalesOrder)-[a:CONTAINS_PART]->(p:Part) MATCH (o)-[b:CONTAINS_PART]->(p) WHERE a.line = 1 AND b.line = 2 RETURN o.id AS o, p.id AS p", "SELECT a.src AS o, a.dst AS p FROM e a JOIN e b ON a.src = b.src AND a.dst = b.dst AND b.type = a.type WHERE a.type = 'CONTAINS_PART' AND a.line = 1 AND b.line = 2")
_cypher("optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:SalesOrder) RETURN c.id AS c, o.id AS o", "SELECT c.id AS c, e.dst AS o FROM n c LEFT JOIN e ON e.src = c.id AND e.type = 'PLACED' WHERE c.label = 'Customer'")
_cypher("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:SalesOrder) WHERE o.status = 'P' RETURN c.id AS c, o.qualified_name AS o", "SELECT c.id AS c, o.qname AS o FROM n c LEFT JOIN (SELECT e.src, o.qname FROM e JOIN n o ON o.id = e.dst AND o.status = 'P' WHERE e.type = 'PLACED') o ON o.src = c.id WHERE c.label = 'Customer'")
_cypher("optional_leading_null", "OPTIONAL MATCH (x:Nothing) RETURN x.id AS id, count(*) AS c", "SELECT NULL::BIGINT AS id, 1::BIGINT AS c")

# aggregates and WITH
_cypher("count_star", "MATCH (o:SalesOrder) RETURN count(*) AS c", "SELECT count(*) AS c FROM n WHERE label = 'SalesOrder'")
_cypher("count_empty", "MATCH (o:Nothing) RETURN count(*) AS c", "SELECT 0::BIGINT AS c")
_cypher("count_group", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(c) AS customers ORDER BY n.name", "SELECT x.name AS nation, count(*) AS customers FROM e JOIN n x ON x.id = e.dst WHERE e.type = 'IN_NATION' AND e.src < 4000000000000 GROUP BY x.id, x.name")
_cypher("count_entity_key", "MATCH (s:Supplier)<-[:SUPPLIED_BY]-(o:SalesOrder) WITH s, count(o) AS c RETURN s.name AS name, c", "SELECT x.name, count(*) AS c FROM e JOIN n x ON x.id = e.dst WHERE e.type = 'SUPPLIED_BY' GROUP BY x.id, x.name")
_cypher("count_optional_zero", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:SalesOrder) RETURN c.name AS name, count(o) AS orders", "SELECT c.name, count(e.id) AS orders FROM n c LEFT JOIN e ON e.src = c.id AND e.type = 'PLACED' WHERE c.label = 'Customer' GROUP BY c.name")
_cypher("having", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) WITH c, count(o) AS k WHERE k = 10 RETURN c.name AS name, k", "SELECT c.name, count(*) AS k FROM e JOIN n c ON c.id = e.src WHERE e.type = 'PLACED' GROUP BY c.id, c.name HAVING count(*) = 10")
_cypher("with_alias_rematch", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n AS land, r.name AS region MATCH (land)<-[:IN_NATION]-(s:Supplier) RETURN region, count(s) AS c", "SELECT r.name AS region, count(*) AS c FROM e a JOIN n r ON r.id = a.dst JOIN e b ON b.dst = a.src AND b.type = 'IN_NATION' WHERE a.type = 'IN_REGION' AND b.src >= 4000000000000 GROUP BY r.name")
_cypher("with_star", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) WITH * RETURN n.name AS n, r.edge_type AS t, g.name AS g", "SELECT x.name AS n, e.type AS t, g.name AS g FROM e JOIN n x ON x.id = e.src JOIN n g ON g.id = e.dst WHERE e.type = 'IN_REGION'")
_cypher("with_distinct", "MATCH (o:SalesOrder)-[:CONTAINS_PART]->(p:Part) WITH DISTINCT o, p.brand AS brand RETURN brand, count(*) AS orders", "SELECT brand, count(*) AS orders FROM (SELECT DISTINCT e.src, p.brand FROM e JOIN n p ON p.id = e.dst WHERE e.type = 'CONTAINS_PART') GROUP BY brand")
_cypher("with_topk_then_match", "MATCH (c:Customer) WITH c ORDER BY c.name LIMIT 5 MATCH (c)-[:PLACED]->(o:SalesOrder) RETURN c.name AS name, count(o) AS orders", "SELECT c.name, count(*) AS orders FROM (SELECT id, name FROM n WHERE label = 'Customer' ORDER BY name LIMIT 5) c JOIN e ON e.src = c.id AND e.type = 'PLACED' GROUP BY c.name")
_cypher("with_where_before_limit", "MATCH (c:Customer) WITH c.name AS name, c.segment AS seg ORDER BY name LIMIT 3 WHERE seg = 'MACHINERY' RETURN name", "SELECT name FROM n WHERE label = 'Customer' AND segment = 'MACHINERY' ORDER BY name LIMIT 3")


# typed operators
def _graph(run):
    return lambda spark, d: run(bind_tables(spark, d))


def _search(name: str, sql: str, columns: str = "id, label, name, qualified_name", **filters) -> None:
    _add("search_" + name, _graph(lambda g: search.search_nodes(g, 1, **filters).selectExpr(*columns.split(", "))), sql)


_N = "SELECT id, label, name, qname AS qualified_name FROM n WHERE "
_search("regex", _N + "label IN ('Customer', 'Supplier') AND regexp_matches(name, '0+[13]5$', 'i')", labels=["Customer", "Supplier"], name_pattern="0+[13]5$")
_search("qname_regex", _N + "regexp_matches(qname, '^part#1\\d\\d$', 'i')", qualified_name_pattern=r"^part#1\d\d$")
_search("glob", _N + "regexp_matches(path, 'customer/1.*', 'i')", file_glob="Customer/1*")
_search("property", _N + "label = 'Part' AND size = 12", labels="Part", properties={"size": 12})
_search("property_bool", _N + "label = 'SalesOrder' AND open", labels="SalesOrder", properties={"open": True})
_DEG = "(SELECT {0} AS id, count(*) AS d FROM e WHERE type = '{1}' GROUP BY 1)"
_search("degree_min", _N + f"label = 'Part' AND id IN (SELECT id FROM {_DEG.format('dst', 'CONTAINS_PART')} WHERE d >= 40)", labels="Part", degree=Degree("CONTAINS_PART", "in", 40))
_search("degree_zero", _N + f"label = 'Customer' AND id NOT IN (SELECT id FROM {_DEG.format('src', 'PLACED')})", labels="Customer", degree=Degree("PLACED", "out", most=0))
_search("degree_both", _N + "label = 'Nation' AND id IN (SELECT id FROM (SELECT src AS id FROM e WHERE type = 'IN_NATION' UNION ALL SELECT dst FROM e WHERE type = 'IN_NATION') GROUP BY id HAVING count(*) BETWEEN 1 AND 60)", labels="Nation", degree=Degree("IN_NATION", "both", 1, 60))
_search("exclude_entry_points", _N + "label = 'Part' AND size % 5 NOT IN (0, 1)", labels="Part", exclude_entry_points=True)
_add("search_page2", _graph(lambda g: search.page_of(search.search_nodes(g, 1, labels="SalesOrder", name_pattern="7$"), 50, 50).select("id", "name")), "SELECT id, name FROM n WHERE label = 'SalesOrder' AND regexp_matches(name, '7$') ORDER BY id LIMIT 50 OFFSET 50")
_add("degree_table", _graph(lambda g: search.degrees(g, 1)), "SELECT id, type AS edge_type, count(*) AS degree FROM (SELECT src AS id, type FROM e UNION ALL SELECT dst, type FROM e) GROUP BY ALL")



# stored indexes: names by trigrams, pages, natural keys, counts kept up with changes
_NAMED = "order#1[0-9]*7$|(customer|supplier)#0+[13]5$"


def _names(spark: SparkSession, d: str) -> NameIndex:
    return once(spark, d, "names", lambda: NameIndex.build(bind_tables(spark, d), 1))


_add("search_regex_indexed", lambda s, d: search.search_nodes(bind_tables(s, d), 1, name_pattern=_NAMED, names=_names(s, d)).select("id", "label", "name", "qualified_name"), _N + f"regexp_matches(name, '{_NAMED}', 'i')")
_add("search_page_far", _graph(lambda g: Pages.build(search.search_nodes(g, 1, labels="SalesOrder"), [F.col("id")]).page(1_000, 50).select("id", "name", "place")), "SELECT id, name, row_number() OVER (ORDER BY id) AS place FROM n WHERE label = 'SalesOrder' ORDER BY id LIMIT 50 OFFSET 1000")
_add(
    "cy_page_seek", lambda s, d: Pages.build(compile_query(bind_tables(s, d), 1, "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) RETURN c.name AS customer, count(o) AS orders ORDER BY customer").frame, []).page(40, 25),
    "SELECT customer, orders, row_number() OVER (ORDER BY customer) AS place FROM (SELECT a.name AS customer, count(*) AS orders FROM e JOIN n a ON a.id = e.src WHERE e.type = 'PLACED' GROUP BY a.id, a.name) ORDER BY customer LIMIT 25 OFFSET 40",
)


def _sold_parts(spark: SparkSession, d: str) -> DataFrame:
    keys = once(spark, d, "keys", lambda: NodeKeys.build(bind_tables(spark, d), 1))
    return keys.find(spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("Part").alias("label"), F.concat(F.lit("Part#"), "l_partkey").alias("qualified_name"))).select("id", "label", "name", "qualified_name")


_add("lookup_natural_keys", _sold_parts, _N + "label = 'Part' AND id - 5000000000000 IN (SELECT l_partkey FROM lineitem)")


def _counts_after(spark: SparkSession, d: str) -> DataFrame:
    """The bound graph's counts after orders with a key divisible by 97 have gone with their edges, and those divisible by
    89 were placed once more."""
    g = bind_tables(spark, d)
    before = once(spark, d, "counts", lambda: stage(counts.counts_of(g.nodes, g.edges)))
    key = lambda c: F.when(F.col(c).between(ORDER * KIND, ORDER * KIND + KIND - 1), F.col(c) - ORDER * KIND)
    gone = lambda c: F.coalesce(key(c) % 97 == 0, F.lit(False))
    again = g.edges.where((F.col("edge_type") == "PLACED") & (key("target_id") % 89 == 0) & ~gone("target_id"))
    return counts.merged(before, stage(counts.change(g.nodes.where(gone("id")), g.edges.where(gone("source_id") | gone("target_id")), g.nodes.where("false"), again)))


_LEFT = """, was AS (SELECT coalesce(src // 1000000000000 = 6 AND src % 97 = 6000000000000 % 97, false) OR coalesce(dst // 1000000000000 = 6 AND dst % 97 = 6000000000000 % 97, false) AS gone, * FROM e),
now AS (SELECT src, dst, type FROM was WHERE NOT gone UNION ALL SELECT src, dst, type FROM was WHERE NOT gone AND type = 'PLACED' AND (dst - 6000000000000) % 89 = 0) """
_add("degrees_after_change", lambda s, d: counts.degrees(_counts_after(s, d), 1), _LEFT + "SELECT id, type AS edge_type, count(*) AS degree FROM (SELECT src AS id, type FROM now UNION ALL SELECT dst, type FROM now) GROUP BY ALL")
_add("edge_counts_after_change", lambda s, d: counts.histogram(_counts_after(s, d), 1, "type"), _LEFT + "SELECT type AS edge_type, count(*) AS count FROM now GROUP BY type")
_add("node_counts_after_change", lambda s, d: counts.histogram(_counts_after(s, d), 1, "label"), "SELECT label, count(*) AS count FROM n WHERE NOT (label = 'SalesOrder' AND (id - 6000000000000) % 97 = 0) GROUP BY label")
_add(
    "search_degree_after_change", lambda s, d: search.search_nodes(bind_tables(s, d), 1, labels="Customer", degree=Degree("PLACED", "out", 12), counts=_counts_after(s, d)).select("id", "label", "name", "qualified_name"),
    _LEFT + _N + "label = 'Customer' AND id IN (SELECT src FROM now WHERE type = 'PLACED' GROUP BY src HAVING count(*) >= 12)",
)


def _bfs_sql(start: str, direction: str, depth: int, kind: str, where: str) -> str:
    """Levels as nested CTEs: one step a level, nodes at their least depth, edges at the first step that crosses them."""
    step = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    parts = [f", l0 AS (SELECT id, 0 AS depth FROM n WHERE qname = '{start}'), ee AS (SELECT * FROM e WHERE {where})"]
    for k in range(1, depth + 1):
        front = f"(SELECT id FROM l{k - 1} WHERE depth = {k - 1})"
        parts.append(f", s{k} AS (" + " UNION ALL ".join(f"SELECT ee.id, {far} AS far FROM ee JOIN {front} f ON f.id = ee.{near}" for near, far in step) + ")")
        parts.append(f", l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT far, {k} FROM s{k} WHERE far NOT IN (SELECT id FROM l{k - 1}))")
    if kind == "nodes":
        return "".join(parts) + f" SELECT l.id, n.label, n.qname AS qualified_name, l.depth FROM l{depth} l JOIN n ON n.id = l.id"
    return "".join(parts) + " SELECT id, min(depth)::INTEGER AS depth FROM (" + " UNION ALL ".join(f"SELECT id, {k} AS depth FROM s{k}" for k in range(1, depth + 1)) + ") GROUP BY id"


def _trace(name: str, start: str, direction: str, depth: int, where: str = "conf >= 0.6", **how) -> None:
    for kind in ("nodes", "edges") if depth else ("nodes",):
        columns = ["id", "label", "qualified_name", "depth"] if kind == "nodes" else ["id", "depth"]

        def run(spark, d, kind=kind, columns=columns):
            found = trace.trace(bind_tables(spark, d), 1, start, direction=direction, depth=depth, adjacency=adjacency(spark, d), **how)
            return found[kind == "edges"].select(*columns)

        _add(f"trace_{name}_{kind}", run, _bfs_sql(start, direction, depth, kind, where))


_trace("out_d2", "Order#3", "out", 2)
_trace("in_d2", "Part#5", "in", 2)
_trace("both_d3", "NATION#7", "both", 3, "conf >= 0.6 AND type IN ('IN_NATION', 'IN_REGION', 'PLACED')", edge_types=["IN_NATION", "IN_REGION", "PLACED"])
_trace("conf", "Part#5", "in", 1, "conf >= 1.0", min_confidence=1.0)
_trace("d0", "Part#5", "both", 0)

# summaries and reports
_add("schema_node_counts", _graph(lambda g: schema.node_counts(g, 1)), "SELECT label, count(*) AS count FROM n GROUP BY label")
_add("schema_edge_counts", _graph(lambda g: schema.edge_counts(g, 1)), "SELECT type AS edge_type, count(*) AS count FROM e GROUP BY type")
_add("schema_samples", _graph(lambda g: schema.label_samples(g, 1)), "SELECT label, rank, id, qualified_name FROM (SELECT label, id, qname AS qualified_name, row_number() OVER (PARTITION BY label ORDER BY id)::INTEGER AS rank FROM n) WHERE rank <= 5")
_add("project_list", _graph(lambda g: schema.project_list(g).select("id", "name", "node_count", "edge_count")), "SELECT 1::BIGINT AS id, 'tables1' AS name, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count")
_add("reverse_index", _graph(lambda g: schema.reverse_index(g, 1)), "SELECT DISTINCT b.path AS target_file, a.path AS referring_file FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.path <> b.path")

_PART_USE = reports.ImpactRules("Part", ("CONTAINS_PART",), buckets={"SalesOrder": "orders"})
_NATION_USE = reports.ImpactRules("Nation", ("IN_NATION",), buckets={"Customer": "customers", "Supplier": "suppliers"})
_IMPACT = "bucket, kind, label, qualified_name, edge_type, confidence, line".split(", ")
_add("impact_direct", _graph(lambda g: reports.impact(g, 1, "Part#5", rules=_PART_USE).select(*_IMPACT)), "SELECT DISTINCT 'orders' AS bucket, 'direct' AS kind, s.label, s.qname AS qualified_name, e.type AS edge_type, e.conf AS confidence, e.line FROM e JOIN n s ON s.id = e.src WHERE e.type = 'CONTAINS_PART' AND e.dst = 5000000000005")
_add("impact_buckets", _graph(lambda g: reports.impact(g, 1, "NATION#7", rules=_NATION_USE).groupBy("bucket").agg(F.count("*").alias("c"))), "SELECT CASE s.label WHEN 'Customer' THEN 'customers' ELSE 'suppliers' END AS bucket, count(*) AS c FROM e JOIN n s ON s.id = e.src WHERE e.type = 'IN_NATION' AND e.dst = 2000000000007 GROUP BY 1")
_INDIRECT = reports.ImpactRules("Nation", ("IN_REGION",), "Nation", {"Customer": ("IN_NATION",)}, {"Customer": "customers"})
_add("impact_indirect", _graph(lambda g: reports.impact(g, 1, "NATION#7.any", rules=_INDIRECT).select("bucket", "kind", "label", "qualified_name")), "SELECT 'customers' AS bucket, 'indirect' AS kind, s.label, s.qname AS qualified_name FROM e JOIN n s ON s.id = e.src WHERE e.type = 'IN_NATION' AND e.dst = 2000000000007 AND s.label = 'Customer'")
_add("access_grants", _graph(lambda g: reports.grants(g, 1, "Nation", "IN_NATION", "NATION#3").select("id", "label", "qualified_name")), "SELECT s.id, s.label, s.qname AS qualified_name FROM e JOIN n s ON s.id = e.src WHERE e.type = 'IN_NATION' AND e.dst = 2000000000003")
_add(
    "access_groups",
    _graph(lambda g: reports.groups_of(g, 1, reports.grants(g, 1, "Nation", "IN_NATION", "NATION#3").where("label = 'Supplier'"), "SUPPLIED_BY").select("qualified_name", F.concat_ws(",", "members").alias("members"))),
    "SELECT o.qname AS qualified_name, string_agg(DISTINCT s.qname, ',' ORDER BY s.qname) AS members FROM e JOIN n o ON o.id = e.src JOIN n s ON s.id = e.dst WHERE e.type = 'SUPPLIED_BY' AND s.nation = 3 GROUP BY o.id, o.qname",
)

_DIFF = """, ch AS (
  SELECT 'node' AS kind, '["SalesOrder","Order#' || o_orderkey || '"]' AS identity, CASE WHEN o_orderkey % 97 = 0 THEN 'removed' ELSE 'changed' END AS change
  FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0
  UNION ALL SELECT DISTINCT 'edge', '["' || a.label || '","' || a.qname || '","' || e.type || '","' || b.label || '","' || b.qname || '"]', 'removed'
  FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
  WHERE (a.label = 'SalesOrder' AND (a.id - 6000000000000) % 97 = 0) OR (b.label = 'SalesOrder' AND (b.id - 6000000000000) % 97 = 0))
"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.changes(bind_tables(spark, d, snapshot=True), 1, 2)


_add("diff_changes", lambda s, d: _changes(s, d).select("kind", "identity", "change"), _DIFF + "SELECT * FROM ch")
_add("diff_metadata_only", lambda s, d: diff.changes(bind_tables(s, d, snapshot=True), 1, 2, include_source=False).select("kind", "identity", "change"), _DIFF + "SELECT * FROM ch")
_add("diff_summary", lambda s, d: diff.summary(_changes(s, d)), _DIFF + "SELECT change, count(*) AS count FROM ch GROUP BY change")
_add("diff_page2", lambda s, d: diff.page(_changes(s, d), 20, 20).select("kind", "identity", "change"), _DIFF + "SELECT * FROM ch ORDER BY kind, identity LIMIT 20 OFFSET 20")

# what changed, with the content of both sides as canonical JSON
_CONTENT = """, node_form AS (SELECT o_orderkey AS k, '["SalesOrder","Order#' || o_orderkey || '"]' AS identity,
  json_object('properties', '{"open":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}')::VARCHAR AS was,
  json_object('properties', '{"open":' || CASE WHEN o_orderstatus = 'O' THEN 'false' ELSE 'true' END || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}')::VARCHAR AS became FROM orders),
edge_form AS (SELECT '["' || a.label || '","' || a.qname || '","' || e.type || '","' || b.label || '","' || b.qname || '"]' AS identity,
  CASE WHEN e.flag IS NULL THEN '{}' ELSE '{"flag":"' || e.flag || '","line":' || e.line || '}' END AS props, e.conf
  FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
  WHERE (a.label = 'SalesOrder' AND (a.id - 6000000000000) % 97 = 0) OR (b.label = 'SalesOrder' AND (b.id - 6000000000000) % 97 = 0))
SELECT 'node' AS kind, identity, CASE WHEN k % 97 = 0 THEN 'removed' ELSE 'changed' END AS change, was AS before, CASE WHEN k % 97 <> 0 THEN became END AS after
FROM node_form WHERE k % 97 = 0 OR k % 89 = 0
UNION ALL SELECT 'edge', identity, 'removed', '[' || string_agg('{"properties":' || to_json(props)::VARCHAR || ',"confidence":' || conf || '}', ',' ORDER BY props, conf) || ']', NULL FROM edge_form GROUP BY identity
"""
_add("diff_contents", _changes, _CONTENT)


# ingest and resolution
def _changed_files(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("file_path"), F.sha1("text").alias("content_hash"))
    known = docs.where(~F.col("file_path").endswith("7")).withColumn("content_hash", F.when(F.col("file_path").endswith("3"), F.lit("stale")).otherwise(F.col("content_hash")))
    return resolve.changed_files(docs, known)


_add("ingest_changed_files", _changed_files, "SELECT 'doc/' || doc_id AS file_path, sha1(text) AS content_hash FROM documents WHERE doc_id % 10 IN (3, 7)", prefix="")
_add(
    "ingest_refs",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("href")),
    """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages""",
    prefix="",
)


def _best_match(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("ref_id"), F.concat(F.lit("t"), F.col("l_partkey") % 50).alias("name"), (F.col("l_linenumber") % 4).alias("arity")).distinct()
    found = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("t"), F.col("p_partkey") % 60).alias("name"), (F.col("p_size") % 4).alias("arity"), F.col("p_partkey").alias("target_id"))
    return resolve.best_overload(refs, found)


#: Over every part. The ranks are made of the distinct (name, arity), so no reference meets every target of its name.
_BEST_SQL = """WITH r AS (SELECT DISTINCT l_orderkey AS ref_id, 't' || (l_partkey % 50) AS name, l_linenumber % 4 AS arity FROM lineitem),
    t AS (SELECT 't' || (p_partkey % 60) AS name, p_size % 4 AS arity, min(p_partkey) AS target_id, count(*) AS n FROM part GROUP BY ALL),
    m AS (SELECT ref_id, r.name, r.arity, target_id,
      sum(CASE WHEN t.arity = r.arity THEN n ELSE 0 END) OVER w AS n_exact,
      row_number() OVER (PARTITION BY ref_id, r.name, r.arity ORDER BY (t.arity = r.arity) DESC, (t.arity = 0) DESC, target_id) AS rn
      FROM r JOIN t ON t.name = r.name WINDOW w AS (PARTITION BY ref_id, r.name, r.arity))
    SELECT ref_id, name, arity, target_id, CASE WHEN n_exact = 1 THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence FROM m WHERE rn = 1"""
_add("resolve_best_match", _best_match, _BEST_SQL, prefix="")
_add("resolve_best_match_all", _best_match, _BEST_SQL, prefix="")
QUERIES |= ingest_queries.QUERIES
ORACLE |= ingest_queries.ORACLE
