"""Queries over an indexed project tree whose files are made from the tables, a file a row, with the SQL of the graph
that must come out: parsing, upsert, placeholders, and the joins that turn names into edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.kept import once
from tessera.plans.compiler import compile_query
from tessera.operators import reports
from tessera.sources import project
from tessera.sources.sinks import write_files
from tessera.staging import temporary_folder
from tessera.streaming.ingest import graph_of_files

# Fixed files beside those of the tables.
_FIXED = (
    ("apex_class", "classes/Sized.cls", None, "public interface Sized { }"),
    ("object", "objects/Part__c/Part__c.object-meta.xml", "Part__c", "<CustomObject><label>Part</label></CustomObject>"),
    ("object", "objects/Region__c/Region__c.object-meta.xml", "Region__c", "<CustomObject><label>Region</label></CustomObject>"),
    ("field", "objects/Part__c/fields/Region__c.field-meta.xml", "Part__c", "<CustomField><fullName>Region__c</fullName><type>Lookup</type><referenceTo>Region__c</referenceTo></CustomField>"),
    ("field", "objects/Region__c/fields/Title__c.field-meta.xml", "Region__c", "<CustomField><fullName>Title__c</fullName><type>Text</type></CustomField>"),
)


def _text(form: str, **values: str) -> Column:
    """``form`` with each ``«name»`` replaced by the SQL expression of that name."""
    parts: list[Column] = []
    while form:
        head, _, form = form.partition("«")
        name, _, form = form.partition("»")
        parts += [F.lit(head)] + ([F.expr(values[name]).cast("string")] if name else [])
    return F.concat(*parts)


def _file(rows: DataFrame, kind: str, path: str, *texts: tuple[str, str], parent: str | None = None, **values: str) -> DataFrame:
    parts = F.array(*[F.struct(_text(name, **values).alias("name"), _text(text, **values).alias("text")) for name, text in texts])
    return rows.select(F.lit(kind).alias("kind"), _text(path, **values).alias("file_path"), F.lit(parent).cast("string").alias("parent"), parts.alias("parts"))


def files_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, file_path, parent, content_hash and parts of a project tree: classes from parts, fields from nations, rules,
    triggers and Aura bundles from regions, permission sets from customers, and the rest from suppliers."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    part = {"k": "p_partkey", "up": "p_partkey div 2", "base": "if(p_partkey > 1, concat(' extends P', p_partkey div 2), '')", "more": "if(p_size % 2 = 0, ', 2', '')", "again": "if(p_partkey % 3 = 0, 'go(1);', '')", "f": "p_size % 25"}
    nation = {"n": "n_nationkey", "sum": "if(n_nationkey % 5 = 0, '<summarizedField>Region__c.Title__c</summarizedField>', '')"}
    region = {"r": "r_regionkey", "up": "r_regionkey + 5", "p": "r_regionkey + 1"}
    customer = {"c": "c_custkey", "p": "c_custkey % 100 + 1", "n": "c_nationkey", "on": "c_acctbal > 0", "edit": "c_acctbal > 5000"}
    supplier = {"s": "s_suppkey", "next": "s_suppkey + 1", "n": "s_nationkey", "m": "(s_nationkey + 1) % 25"}
    cls = (
        "public with sharing class P«k»«base» implements Sized {\n  public Integer size;\n  public static void go(Integer a) { P«up».go(1«more»); «again» }\n"
        "  public void look() { List<Part__c> r = [SELECT Name, Region__r.Title__c FROM Part__c WHERE F«f»__c != null]; P«k» x = new P«k»(); }\n}"
    )
    flow = (
        "<Flow><start><object>Part__c</object><triggerType>RecordAfterSave</triggerType></start><actionCalls><name>a</name><actionType>apex</actionType><actionName>P«s»</actionName></actionCalls>"
        "<recordLookups><name>L</name><object>Part__c</object><filters><field>F«m»__c</field></filters></recordLookups>"
        "<recordUpdates><name>U</name><inputReference>$Record</inputReference><inputAssignments><field>F«n»__c</field></inputAssignments></recordUpdates></Flow>"
    )
    grants = (
        "<PermissionSet><classAccesses><apexClass>P«p»</apexClass><enabled>«on»</enabled></classAccesses>"
        "<fieldPermissions><field>Part__c.F«n»__c</field><readable>true</readable><editable>«edit»</editable></fieldPermissions></PermissionSet>"
    )
    parts = "array<struct<name: string, text: string>>"
    fixed = spark.createDataFrame([(k, p, o, [(p.rsplit("/", 1)[-1], t)]) for k, p, o, t in _FIXED], f"kind string, file_path string, parent string, parts {parts}")
    some = [
        _file(table("part"), "apex_class", "classes/P«k».cls", ("P«k».cls", cls), **part),
        _file(table("nation"), "field", "objects/Part__c/fields/F«n»__c.field-meta.xml", ("F", "<CustomField><fullName>F«n»__c</fullName><type>Number</type>«sum»</CustomField>"), parent="Part__c", **nation),
        _file(table("region"), "validation_rule", "objects/Part__c/validationRules/V«r».validationRule-meta.xml", ("V", "<ValidationRule><fullName>V«r»</fullName><active>true</active><errorConditionFormula>AND(ISBLANK(F«r»__c), Part__c.F«up»__c = 'x')</errorConditionFormula></ValidationRule>"), parent="Part__c", **region),
        _file(table("region"), "apex_trigger", "triggers/T«r».trigger", ("T«r».trigger", "trigger T«r» on Part__c (before insert, after update) { }"), **region),
        _file(table("region"), "aura", "aura/A«r»", ("A«r».cmp", "<aura:component controller=\"P«p»\"><c:c«p»/></aura:component>"), ("A«r»Controller.js", "({ f: function(c) { c.get('c.go'); } })"), **region),
        _file(table("customer"), "permission_set", "permissionsets/S«c».permissionset-meta.xml", ("S", grants), **customer),
        _file(table("supplier"), "permission_set_group", "permissionsetgroups/G«s».permissionsetgroup-meta.xml", ("G", "<PermissionSetGroup><permissionSets>S«s»</permissionSets><permissionSets>S«next»</permissionSets></PermissionSetGroup>"), **supplier),
        _file(table("supplier"), "flow", "flows/W«s».flow-meta.xml", ("W", flow), **supplier),
        _file(table("supplier"), "lwc", "lwc/c«s»", ("c«s».js", "import go from '@salesforce/apex/P«s».go';\nimport F from '@salesforce/schema/Part__c.F«n»__c';"), ("c«s».html", "<template><c-c«next»></c-c«next»></template>"), **supplier),
        _file(table("supplier"), "vf_page", "pages/V«s».page", ("V«s».page", "<apex:page controller=\"P«s»\"><apex:outputField value=\"{!Part__c.F«n»__c}\"/></apex:page>"), **supplier),
    ]
    made = reduce(DataFrame.unionByName, [fixed, *some])
    return made.withColumn("content_hash", F.sha1(F.to_json("parts")))


def indexed_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of that tree, made once for as long as the tables stay as they are."""
    return once(spark, sf_dir, "index", lambda: graph_of_files(spark, files_of_tables(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[PropertyGraph], DataFrame], sql: str) -> None:
    QUERIES["ingest_" + name], ORACLE["ingest_" + name] = lambda spark, d: run(indexed_tables(spark, d)), sql


def _nodes(label: str, *properties: str) -> Callable[[PropertyGraph], DataFrame]:
    def run(g: PropertyGraph) -> DataFrame:
        return g.nodes.where(F.col("label") == label).select("name", "qualified_name", "file_path", *[F.get_json_object("properties", f"$.{p}").alias(p) for p in properties])

    return run


def _edges(types: str, *properties: str, graph: Callable[[PropertyGraph], PropertyGraph] = lambda g: g) -> Callable[[PropertyGraph], DataFrame]:
    def run(given: PropertyGraph) -> DataFrame:
        g = graph(given)
        ends = g.nodes.select("id", "label", "qualified_name")
        found = g.edges.where(F.col("edge_type").isin(types.split()))
        for side in ("source", "target"):
            found = found.join(ends.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("qualified_name").alias(side)), f"{side}_id")
        return found.select("edge_type", "source_label", "source", "target_label", "target", "confidence", *[F.get_json_object("properties", f"$.{p}").alias(p) for p in properties])

    return run


def _sql(kind: str, a: str, aq: str, b: str, bq: str, rest: str, conf: float = 1.0) -> str:
    return f"SELECT '{kind}' AS edge_type, '{a}' AS source_label, {aq} AS source, '{b}' AS target_label, {bq} AS target, {conf}::DOUBLE AS confidence{rest}"


_CLASS, _FIELD = "'P' || p_partkey", "'Part__c.F' || s_nationkey || '__c'"
_PARTS = "(SELECT p_partkey FROM part)"

# nodes
_add(
    "node_counts", lambda g: g.nodes.groupBy("label").agg(F.count("*").alias("count")),
    """SELECT * FROM (VALUES ('ApexInterface', 1), ('SObject', 2)) v(label, count)
    UNION ALL SELECT 'ApexClass', count(*) FROM part UNION ALL SELECT 'ApexMethod', 2 * count(*) FROM part UNION ALL SELECT 'ApexProperty', count(*) FROM part
    UNION ALL SELECT 'Field', 2 + count(*) FROM nation UNION ALL SELECT 'ValidationRule', count(*) FROM region UNION ALL SELECT 'ApexTrigger', count(*) FROM region
    UNION ALL SELECT unnest(['AuraBundle', 'AuraComponent', 'AuraController']), count(*) FROM region UNION ALL SELECT 'PermissionSet', count(*) FROM customer
    UNION ALL SELECT unnest(['PermissionSetGroup', 'Flow', 'LwcBundle', 'LwcModule', 'LwcTemplate', 'VisualforcePage']), count(*) FROM supplier""",
)
_add("classes", _nodes("ApexClass", "sharing", "isAbstract"), f"SELECT {_CLASS} AS name, {_CLASS} AS qualified_name, 'classes/P' || p_partkey || '.cls' AS file_path, 'with' AS sharing, 'false' AS \"isAbstract\" FROM part")
_add(
    "methods", _nodes("ApexMethod", "ownerClass", "arity", "isStatic", "returnType"),
    f"""SELECT m AS name, {_CLASS} || '.' || m || p AS qualified_name, 'classes/P' || p_partkey || '.cls' AS file_path, {_CLASS} AS "ownerClass", a AS arity, s AS "isStatic", 'void' AS "returnType"
    FROM part, (VALUES ('go', '(Integer)', '1', 'true'), ('look', '()', '0', 'false')) v(m, p, a, s)""",
)
_add("properties", _nodes("ApexProperty", "type", "isMemberVariable"), f"SELECT 'size' AS name, {_CLASS} || '.size' AS qualified_name, 'classes/P' || p_partkey || '.cls' AS file_path, 'Integer' AS type, 'true' AS \"isMemberVariable\" FROM part")
_add(
    "fields", _nodes("Field", "type", "sObject", "referenceTo"),
    """SELECT 'F' || n_nationkey || '__c' AS name, 'Part__c.F' || n_nationkey || '__c' AS qualified_name, 'objects/Part__c/fields/F' || n_nationkey || '__c.field-meta.xml' AS file_path, 'Number' AS type, 'Part__c' AS "sObject", NULL::VARCHAR AS "referenceTo" FROM nation
    UNION ALL VALUES ('Region__c', 'Part__c.Region__c', 'objects/Part__c/fields/Region__c.field-meta.xml', 'Lookup', 'Part__c', 'Region__c'), ('Title__c', 'Region__c.Title__c', 'objects/Region__c/fields/Title__c.field-meta.xml', 'Text', 'Region__c', NULL)""",
)
_add("real_beats_placeholder", _nodes("SObject", "isPlaceholder", "label"), "SELECT * FROM (VALUES ('Part__c', 'Part__c', 'objects/Part__c/Part__c.object-meta.xml', NULL::VARCHAR, 'Part'), ('Region__c', 'Region__c', 'objects/Region__c/Region__c.object-meta.xml', NULL, 'Region')) v(name, qualified_name, file_path, \"isPlaceholder\", label)")

# edges between classes
_add("extends", _edges("EXTENDS"), _sql("EXTENDS", "ApexClass", _CLASS, "ApexClass", "'P' || p_partkey // 2", " FROM part WHERE p_partkey > 1"))
_add("implements", _edges("IMPLEMENTS"), _sql("IMPLEMENTS", "ApexClass", _CLASS, "ApexInterface", "'Sized'", " FROM part"))
_add("instantiates", _edges("INSTANTIATES"), _sql("INSTANTIATES", "ApexMethod", f"{_CLASS} || '.look()'", "ApexClass", _CLASS, " FROM part"))
_CALLS = (
    _sql("CALLS", "ApexMethod", f"{_CLASS} || '.go(Integer)'", "ApexMethod", "'P' || p_partkey // 2 || '.go(Integer)'", f" FROM part WHERE p_partkey // 2 IN {_PARTS}").replace("1.0::DOUBLE", "CASE WHEN p_size % 2 = 0 THEN 0.4 ELSE 1.0 END::DOUBLE")
    + " UNION ALL " + _sql("CALLS", "ApexMethod", f"{_CLASS} || '.go(Integer)'", "ApexMethod", f"{_CLASS} || '.go(Integer)'", " FROM part WHERE p_partkey % 3 = 0")
)
_add("calls", _edges("CALLS"), _CALLS)
_add("self_calls", lambda g: compile_query(g, 1, "MATCH (m:ApexMethod)-[r:CALLS]->(m) RETURN m.name AS name, count(r) AS c").frame, "SELECT 'go' AS name, sum((p_partkey % 3 = 0)::BIGINT + (p_partkey // 2 = p_partkey)::BIGINT)::BIGINT AS c FROM part")
_add(
    "defines", _edges("DEFINES_METHOD DEFINES_PROPERTY"),
    _sql("DEFINES_METHOD", "ApexClass", _CLASS, "ApexMethod", f"{_CLASS} || m", " FROM part, (VALUES ('.go(Integer)'), ('.look()')) v(m)") + " UNION ALL " + _sql("DEFINES_PROPERTY", "ApexClass", _CLASS, "ApexProperty", f"{_CLASS} || '.size'", " FROM part"),
)
_add("soql_objects", _edges("SOQL_QUERIES"), _sql("SOQL_QUERIES", "ApexMethod", f"{_CLASS} || '.look()'", "SObject", "'Part__c'", " FROM part"))
_add(
    "soql_fields", _edges("REFERENCES_FIELD", "context"),
    _sql("REFERENCES_FIELD", "ApexMethod", f"{_CLASS} || '.look()'", "Field", "'Part__c.F' || p_size % 25 || '__c'", ", 'SOQL_WHERE' AS context FROM part")
    + " UNION ALL " + _sql("REFERENCES_FIELD", "ApexMethod", f"{_CLASS} || '.look()'", "Field", "'Region__c.Title__c'", ", 'SOQL_SELECT' AS context FROM part"),
)
_add("triggers", _edges("TRIGGERS_ON", "events"), _sql("TRIGGERS_ON", "ApexTrigger", "'T' || r_regionkey", "SObject", "'Part__c'", ", '[\"before insert\",\"after update\"]' AS events FROM region"))

# edges from metadata
_add("formula_fields", _edges("FORMULA_REFERENCES_FIELD"), _sql("FORMULA_REFERENCES_FIELD", "Field", "'Part__c.F' || n_nationkey || '__c'", "Field", "'Region__c.Title__c'", " FROM nation WHERE n_nationkey % 5 = 0", 0.8))
_add("rule_fields", _edges("VALIDATION_REFERENCES_FIELD"), _sql("VALIDATION_REFERENCES_FIELD", "ValidationRule", "'Part__c.V' || r_regionkey", "Field", "'Part__c.F' || r_regionkey + d || '__c'", " FROM region, (VALUES (0), (5)) v(d)", 0.6))
_add(
    "grants", _edges("GRANTS_APEX_ACCESS GRANTS_FIELD_ACCESS", "enabled", "readable", "editable"),
    _sql("GRANTS_APEX_ACCESS", "PermissionSet", "'S' || c_custkey", "ApexClass", "'P' || c_custkey % 100 + 1", f", (c_acctbal > 0)::VARCHAR AS enabled, NULL::VARCHAR AS readable, NULL::VARCHAR AS editable FROM customer WHERE c_custkey % 100 + 1 IN {_PARTS}")
    + " UNION ALL " + _sql("GRANTS_FIELD_ACCESS", "PermissionSet", "'S' || c_custkey", "Field", "'Part__c.F' || c_nationkey || '__c'", ", NULL, 'true', (c_acctbal > 5000)::VARCHAR FROM customer"),
)
_add("groups", _edges("INCLUDES_PERMSET"), _sql("INCLUDES_PERMSET", "PermissionSetGroup", "'G' || s_suppkey", "PermissionSet", "'S' || s_suppkey + d", " FROM supplier, (VALUES (0), (1)) v(d) WHERE s_suppkey + d IN (SELECT c_custkey FROM customer)"))
_add("flow_objects", _edges("FLOW_DML_ON", "operation"), _sql("FLOW_DML_ON", "Flow", "'W' || s_suppkey", "SObject", "'Part__c'", ", o AS operation FROM supplier, (VALUES ('trigger'), ('select'), ('update')) v(o)"))
_add(
    "flow_fields", _edges("FLOW_USES_FIELD", "context"),
    _sql("FLOW_USES_FIELD", "Flow", "'W' || s_suppkey", "Field", _FIELD, ", 'assignment' AS context FROM supplier") + " UNION ALL "
    + _sql("FLOW_USES_FIELD", "Flow", "'W' || s_suppkey", "Field", "'Part__c.F' || (s_nationkey + 1) % 25 || '__c'", ", 'filter' AS context FROM supplier"),
)
_add("flow_actions", _edges("INVOCABLE_FROM_FLOW"), _sql("INVOCABLE_FROM_FLOW", "Flow", "'W' || s_suppkey", "ApexClass", "'P' || s_suppkey", f" FROM supplier WHERE s_suppkey IN {_PARTS}", 0.8))
_add(
    "components", _edges("LWC_USES_APEX LWC_USES_FIELD LWC_INCLUDES_COMPONENT"),
    _sql("LWC_USES_APEX", "LwcBundle", "'c' || s_suppkey", "ApexMethod", "'P' || s_suppkey || '.go(Integer)'", f" FROM supplier WHERE s_suppkey IN {_PARTS}", 0.8) + " UNION ALL "
    + _sql("LWC_USES_FIELD", "LwcBundle", "'c' || s_suppkey", "Field", _FIELD, " FROM supplier") + " UNION ALL "
    + _sql("LWC_INCLUDES_COMPONENT", "LwcBundle", "'c' || s_suppkey", "LwcBundle", "'c' || s_suppkey + 1", " FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)"),
)
_add(
    "aura", _edges("AURA_USES_APEX AURA_INCLUDES_COMPONENT"),
    _sql("AURA_USES_APEX", "AuraBundle", "'A' || r_regionkey", "ApexClass", "'P' || r_regionkey + 1", " FROM region") + " UNION ALL "
    + _sql("AURA_USES_APEX", "AuraBundle", "'A' || r_regionkey", "ApexMethod", "'P' || r_regionkey + 1 || '.go(Integer)'", " FROM region", 0.8) + " UNION ALL "
    + _sql("AURA_INCLUDES_COMPONENT", "AuraBundle", "'A' || r_regionkey", "LwcBundle", "'c' || r_regionkey + 1", " FROM region WHERE r_regionkey + 1 IN (SELECT s_suppkey FROM supplier)"),
)
_add(
    "pages", _edges("VF_USES_APEX VF_USES_FIELD"),
    _sql("VF_USES_APEX", "VisualforcePage", "'V' || s_suppkey", "ApexClass", "'P' || s_suppkey", f" FROM supplier WHERE s_suppkey IN {_PARTS}") + " UNION ALL "
    + _sql("VF_USES_FIELD", "VisualforcePage", "'V' || s_suppkey", "Field", _FIELD, " FROM supplier", 0.6),
)


# all uses of all fields of the tree, and, with those of its object, of one of them
_USES = f"""WITH u AS (
  SELECT target AS field, 'apex_methods' AS list, source AS qualified_name, context FROM ({ORACLE["ingest_soql_fields"]})
  UNION ALL SELECT target, 'formula_fields', source, edge_type FROM ({ORACLE["ingest_formula_fields"]})
  UNION ALL SELECT DISTINCT target, 'flows', source, edge_type FROM ({ORACLE["ingest_flow_fields"]})
  UNION ALL SELECT target, 'validation_rules', source, edge_type FROM ({ORACLE["ingest_rule_fields"]}) WHERE edge_type = 'VALIDATION_REFERENCES_FIELD'
  UNION ALL SELECT target, 'lwc_bundles', source, edge_type FROM ({ORACLE["ingest_components"]}) WHERE edge_type = 'LWC_USES_FIELD'
  UNION ALL SELECT target, 'vf_pages', source, edge_type FROM ({ORACLE["ingest_pages"]}) WHERE edge_type = 'VF_USES_FIELD'
  UNION ALL SELECT target, 'permission_sets', source, edge_type FROM (SELECT edge_type, source, target FROM ({ORACLE["ingest_grants"]})) WHERE edge_type = 'GRANTS_FIELD_ACCESS')
"""


def _usages(g: PropertyGraph, fields: DataFrame, include_indirect: bool) -> DataFrame:
    return reports.field_usages(g, 1, fields, include_indirect).select("field", "list", "qualified_name", "context")


_add("field_usage", lambda g: _usages(g, g.nodes.where("label = 'Field'").select(F.col("qualified_name").alias("field")), False), _USES + "SELECT * FROM u")
_add(
    "field_usage_indirect", lambda g: _usages(g, g.nodes.where("label = 'Field' and qualified_name = 'Region__c.Title__c' or qualified_name = 'Part__c.F7__c'").select(F.col("qualified_name").alias("field")), True),
    _USES + f"""SELECT * FROM u WHERE field IN ('Region__c.Title__c', 'Part__c.F7__c')
    UNION ALL SELECT 'Part__c.F7__c', 'apex_methods', source, 'SOQL' FROM ({ORACLE["ingest_soql_objects"]}) WHERE target = 'Part__c'
    UNION ALL SELECT 'Part__c.F7__c', 'flows', source, operation FROM ({ORACLE["ingest_flow_objects"]}) WHERE target = 'Part__c'""",
)


# writes
def _without_sevenths(g: PropertyGraph) -> PropertyGraph:
    gone = g.nodes.where(F.col("label") == "ApexClass").where("cast(substr(name, 2) as long) % 7 = 0").select("file_path")
    return g.delete_files(1, gone)


def _again(g: PropertyGraph) -> DataFrame:
    """Classes upserted once more, every second with a new hash, and one class that is new: ids stay."""
    old = g.nodes.where("label = 'ApexClass'")
    some = old.where("cast(substr(name, 2) as long) % 2 = 0").withColumn("content_hash", F.lit("new"))
    fresh = old.where("name = 'P2'").withColumns({c: F.lit("Fresh") for c in ("name", "qualified_name")})
    after = g.upsert_nodes(some.unionByName(fresh).drop("id"), at=9).nodes.where("label = 'ApexClass'")
    both = after.join(old.select(F.col("id").alias("_id"), "qualified_name"), "qualified_name", "left")
    return both.select("qualified_name", F.col("id").eqNullSafe(F.col("_id")).alias("same_id"), (F.col("content_hash") == "new").alias("renewed"), (F.col("updated_at") == 9).alias("touched"))


_add("deleted_files", _edges("CALLS", graph=_without_sevenths), f"SELECT * FROM ({_CALLS}) WHERE regexp_extract(source, 'P(\\d+)', 1)::BIGINT % 7 <> 0 AND regexp_extract(target, 'P(\\d+)', 1)::BIGINT % 7 <> 0")
_add(
    "upserted", _again,
    "SELECT 'P' || p_partkey AS qualified_name, true AS same_id, p_partkey % 2 = 0 AS renewed, p_partkey % 2 = 0 AS touched FROM part UNION ALL SELECT 'Fresh', false, false, true",
)


# discovery of a tree on disk, in which every supplier, customer, nation and region has files
def _tree(spark: SparkSession, sf_dir: str) -> str:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def files(rows: DataFrame, path: str, text: str, **values: str) -> DataFrame:
        return rows.select(_text("pkg/main/default/" + path, **values).alias("path"), _text(text, **values).alias("text"))

    made = [
        files(table("supplier"), "classes/_more/_S«k».cls", "public class S«k» { }", k="s_suppkey"), files(table("customer"), "objects/C/fields/F«k».field-meta.xml", "<CustomField>«n»</CustomField>", k="c_custkey", n="c_name"),
        files(table("nation"), "lwc/n«k»/n«k».js", "export default «k»;", k="n_nationkey"), files(table("nation"), "lwc/n«k»/_n«k».html", "<template>«n»</template>", k="n_nationkey", n="n_name"),
        files(table("region"), "triggers/T«k».trigger", "", k="r_regionkey").withColumn("text", F.lit("")), files(table("region"), "classes/.R«k».cls", "hidden", k="r_regionkey"),
        spark.createDataFrame([("sfdx-project.json", '{"packageDirectories": [{"path": "pkg"}, {"path": "absent"}]}')], "path string, text string"),
    ]
    return write_files(reduce(DataFrame.unionByName, made), temporary_folder(spark, "tree"))


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = project.discover(spark, once(spark, sf_dir, "tree", lambda: _tree(spark, sf_dir)))
    return found.select("kind", "file_path", "parent", "content_hash", F.size("parts").alias("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["text"])).alias("characters"))


QUERIES["discover_files"] = _discovered
ORACLE["discover_files"] = """WITH f AS (
  SELECT 'apex_class' AS kind, 'classes/_more/_S' || s_suppkey || '.cls' AS below, NULL AS parent, 'public class S' || s_suppkey || ' { }' AS text FROM supplier
  UNION ALL SELECT 'field', 'objects/C/fields/F' || c_custkey || '.field-meta.xml', 'C', '<CustomField>' || c_name || '</CustomField>' FROM customer
  UNION ALL SELECT 'apex_trigger', 'triggers/T' || r_regionkey || '.trigger', NULL, '' FROM region),
b AS (SELECT n_nationkey AS k, '<template>' || n_name || '</template>' AS html, 'export default ' || n_nationkey || ';' AS js FROM nation)
SELECT kind, 'pkg/main/default/' || below AS file_path, parent, sha1(text) AS content_hash, 1 AS parts, length(text)::BIGINT AS characters FROM f
UNION ALL SELECT 'lwc', 'pkg/main/default/lwc/n' || k, NULL, sha1('_n' || k || '.html:' || sha1(html) || chr(10) || 'n' || k || '.js:' || sha1(js)), 2, (length(html) + length(js))::BIGINT FROM b"""
