"""Impact of a target (who refers to it, directly or through its parent) and access to it (who grants it)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph


@dataclass(frozen=True)
class ImpactRules:
    """``direct``: edge types into the target. ``indirect``: edge types into the parent named before the first dot, by
    source label. ``buckets``: report list of a source label; other labels go to ``other``."""

    target_label: str
    direct: tuple[str, ...]
    parent_label: str | None = None
    indirect: dict[str, tuple[str, ...]] = field(default_factory=dict)
    buckets: dict[str, str] = field(default_factory=dict)


# How field usage is reported.
FIELD_USAGE = ImpactRules(
    target_label="Field",
    direct=(
        "REFERENCES_FIELD", "LWC_USES_FIELD", "FLOW_USES_FIELD", "LAYOUT_INCLUDES_FIELD", "FLEXIPAGE_REFERENCES_FIELD",
        "VALIDATION_REFERENCES_FIELD", "FORMULA_REFERENCES_FIELD", "VF_USES_FIELD", "EMAIL_REFERENCES_FIELD", "GRANTS_FIELD_ACCESS",
    ),
    parent_label="SObject",
    indirect={"ApexMethod": ("SOQL_QUERIES", "DML_ON"), "ApexTrigger": ("SOQL_QUERIES", "DML_ON"), "Flow": ("FLOW_DML_ON",)},
    buckets={
        "ApexMethod": "apex_methods", "ApexClass": "apex_methods", "ApexTrigger": "apex_triggers", "LwcModule": "lwc", "LwcBundle": "lwc",
        "Flow": "flows", "Layout": "layouts", "FlexiPage": "layouts", "ValidationRule": "validation_rules", "Field": "formulas",
        "VisualforcePage": "visualforce", "VisualforceComponent": "visualforce", "EmailTemplate": "email_templates",
        "PermissionSet": "permission_sets", "Profile": "permission_sets",
    },
)
#: Target type of an access question -> label of the target and grant edge.
ACCESS_TARGETS = {
    "apex": ("ApexClass", "GRANTS_APEX_ACCESS"),
    "object": ("SObject", "GRANTS_OBJECT_ACCESS"),
    "field": ("Field", "GRANTS_FIELD_ACCESS"),
    "visualforce": ("VisualforcePage", "GRANTS_VISUALFORCE_ACCESS"),
    "record_type": ("RecordType", "GRANTS_RECORDTYPE_ACCESS"),
}


def _bucket(rules: ImpactRules) -> Column:
    out = F.lit("other")
    for label, name in rules.buckets.items():
        out = F.when(F.col("label") == label, name).otherwise(out)
    return out


def referrers(graph: PropertyGraph, project_id: int, target: DataFrame, edge_types: list[str], min_confidence: float = 0.0) -> DataFrame:
    """Distinct (edge_type, confidence, context, line, source) of the edges of these types into ``target`` (ids)."""
    edges = graph.project_edges(project_id).where(F.col("edge_type").isin(edge_types) & (F.col("confidence") >= min_confidence))
    into = edges.join(target.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    found = into.select(F.col("source_id").alias("id"), "edge_type", "confidence", F.get_json_object("properties", "$.context").alias("context"), F.col("source_line").alias("line")).distinct()
    return found.join(graph.project_nodes(project_id).select("id", "label", "qualified_name", "file_path"), "id")


def impact(graph: PropertyGraph, project_id: int, qualified_name: str, *, rules: ImpactRules = FIELD_USAGE, include_indirect: bool = True) -> DataFrame:
    """bucket, kind (direct or indirect), label, qualified_name, edge_type, confidence, context, line, file_path."""
    if rules.parent_label and "." not in qualified_name:
        raise ValueError(f"{qualified_name!r} must name its parent, as in Parent.Name")
    target = graph.node_by_name(project_id, rules.target_label, qualified_name)
    out = referrers(graph, project_id, target, list(rules.direct)).withColumn("kind", F.lit("direct"))
    if include_indirect and rules.parent_label:
        parent = graph.node_by_name(project_id, rules.parent_label, qualified_name.split(".")[0])
        kinds = sorted({t for ts in rules.indirect.values() for t in ts})
        more = referrers(graph, project_id, parent, kinds)
        allowed = F.lit(False)
        for label, types in rules.indirect.items():
            allowed = allowed | ((F.col("label") == label) & F.col("edge_type").isin(list(types)))
        out = out.unionByName(more.where(allowed).withColumn("kind", F.lit("indirect")))
    return out.select(_bucket(rules).alias("bucket"), "kind", "label", "qualified_name", "edge_type", "confidence", "context", "line", "file_path")


def grants(graph: PropertyGraph, project_id: int, target_label: str, grant_type: str, qualified_name: str) -> DataFrame:
    """id, label, qualified_name and grant (JSON) of every node that grants access to the target; grants that are
    switched off are listed too."""
    target = graph.node_by_name(project_id, target_label, qualified_name).select(F.col("id").alias("target_id"))
    given = graph.project_edges(project_id).where(F.col("edge_type") == grant_type).join(target, "target_id", "left_semi")
    given = given.select(F.col("source_id").alias("id"), F.col("properties").alias("grant"))
    return given.join(graph.project_nodes(project_id).select("id", "label", "name", "qualified_name"), "id")


def groups_of(graph: PropertyGraph, project_id: int, granting: DataFrame, member_type: str = "INCLUDES_PERMSET") -> DataFrame:
    """Groups that include a granting node: qualified_name, and their members among the granting ones, sorted."""
    member = granting.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("_member")).distinct()
    within = graph.project_edges(project_id).where(F.col("edge_type") == member_type).select("source_id", "target_id").join(member, "target_id")
    listed = within.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("_member")).alias("members"))
    return listed.join(graph.project_nodes(project_id).select("id", "qualified_name"), "id").select("qualified_name", "members")


def access_report(graph: PropertyGraph, project_id: int, target_type: str, qualified_name: str) -> dict:
    if target_type not in ACCESS_TARGETS:
        raise ValueError(f"target type must be one of {', '.join(ACCESS_TARGETS)}")
    label, grant_type = ACCESS_TARGETS[target_type]
    given = grants(graph, project_id, label, grant_type, qualified_name)
    rows = [r.asDict() for r in given.orderBy("qualified_name").collect()]
    sets = [r for r in rows if r["label"] != "Profile"]
    return {
        "permission_sets": sets,
        "profiles": [r for r in rows if r["label"] == "Profile"],
        "groups": [r.asDict() for r in groups_of(graph, project_id, given.where("label != 'Profile'")).orderBy("qualified_name").collect()],
        "total_grants": len(rows),
    }


# The lists of the field report by source label, the edge types behind each, and what it says of itself.
FIELD_LISTS = {
    "ApexMethod": "apex_methods", "LwcBundle": "lwc_bundles", "LwcModule": "lwc_bundles", "VisualforcePage": "vf_pages", "VisualforceComponent": "vf_components",
    "ValidationRule": "validation_rules", "Field": "formula_fields", "AuraBundle": "aura_components", "AuraComponent": "aura_components", "Flow": "flows",
    "Layout": "layouts", "FlexiPage": "layouts", "PermissionSet": "permission_sets", "Profile": "permission_sets", "EmailTemplate": "email_templates", "ApexTrigger": "apex_triggers",
}
FIELD_COVERAGE = {
    "authoritative": ["lwc_bundles", "vf_pages", "vf_components", "validation_rules", "layouts"],
    "indirect": ["apex_methods", "flows"],
    "pending": ["aura_components", "permission_sets", "email_templates", "formula_fields", "flow_relationship_traversal", "flow_screen_choice_fields"],
}


def field_usages(graph: PropertyGraph, project_id: int, fields: DataFrame, include_indirect: bool = True) -> DataFrame:
    """(field, list, qualified_name, name, file_path, line, context) of whatever uses the fields named in the ``field``
    column, for any number of fields in one plan.

    Direct uses are edges into the field, each once; their context is the clause for Apex, else the edge type. Indirect
    ones are queries and changes of its object: SOQL or DML by Apex methods, and a flow's operation. Sources of labels
    without a list are left out; confidence plays no part.
    """
    list_of = F.lit(None).cast("string")
    for label, name in FIELD_LISTS.items():
        list_of = F.when(F.col("label") == label, name).otherwise(list_of)
    sources = graph.project_nodes(project_id).select(F.col("id").alias("source_id"), "label", "qualified_name", "name", "file_path")
    named = graph.project_nodes(project_id).select(F.col("id").alias("target_id"), F.col("label").alias("_label"), F.col("qualified_name").alias("_name"))
    edges = graph.project_edges(project_id).select("source_id", "target_id", "edge_type", F.col("source_line").alias("line"), "properties")
    columns = ["field", list_of.alias("list"), "qualified_name", "name", "file_path", "line", "context"]
    wanted = fields.select("field").distinct()

    to_field = named.where(F.col("_label") == "Field").join(wanted, F.col("_name") == F.col("field")).select("target_id", "field")
    clause = F.when(F.col("label").isin("ApexMethod", "ApexTrigger"), F.coalesce(F.get_json_object("properties", "$.context"), F.lit("SOQL_SELECT"))).otherwise(F.col("edge_type"))
    direct = edges.where(F.col("edge_type").isin(list(FIELD_USAGE.direct))).join(to_field, "target_id").join(sources, "source_id").withColumn("context", clause)
    out = direct.select("edge_type", *columns).distinct().drop("edge_type")
    if include_indirect:
        to_object = named.where(F.col("_label") == "SObject").join(wanted, F.col("_name") == F.substring_index("field", ".", 1)).select("target_id", "field")
        by = {"SOQL_QUERIES": F.lit("SOQL"), "DML_ON": F.lit("DML"), "FLOW_DML_ON": F.coalesce(F.get_json_object("properties", "$.operation"), F.lit("FLOW_DML"))}
        context = F.lit(None).cast("string")
        for kind, said in by.items():
            context = F.when(F.col("edge_type") == kind, said).otherwise(context)
        near = edges.where(F.col("edge_type").isin(list(by))).join(to_object, "target_id").join(sources, "source_id").withColumn("context", context)
        fits = ((F.col("label") == "Flow") & (F.col("edge_type") == "FLOW_DML_ON")) | (F.col("label").isin("ApexMethod", "ApexTrigger") & (F.col("edge_type") != "FLOW_DML_ON"))
        out = out.unionByName(near.where(fits).select(*columns))
    return out.where("list is not null")


def field_report(graph: PropertyGraph, project_id: int, field: str, include_indirect: bool = True) -> dict:
    """The report on one field: its name, its object, the lists of uses, and what each list can be trusted for."""
    if "." not in field:
        return {"error": f'field must be in "Object.Field" form (got "{field}")'}
    out: dict = {"field": field, "parent_sobject": field.split(".")[0]} | {name: [] for name in dict.fromkeys(FIELD_LISTS.values())} | {"coverage": FIELD_COVERAGE}
    asked = graph.spark.createDataFrame([(field,)], "field string")
    for r in field_usages(graph, project_id, asked, include_indirect).orderBy("qualified_name", "line", "context").toLocalIterator():
        out[r["list"]].append({k: r[k] for k in ("qualified_name", "name", "file_path", "line", "context")})
    return out
