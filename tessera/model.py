"""Vocabulary and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies that stored graphs use.
NODE_LABELS = (
    "Project PackageDirectory ApexClass ApexTrigger ApexMethod ApexProperty ApexInterface ApexEnum LwcBundle LwcModule "
    "LwcTemplate LwcMetaConfig AuraBundle AuraComponent AuraController AuraHelper SObject Field RecordType ValidationRule "
    "Layout FlexiPage PermissionSet PermissionSetGroup Profile Flow CustomLabel CustomMetadataType StaticResource "
    "EmailTemplate NamedCredential VisualforcePage VisualforceComponent ExternalNamespace"
).split()
EDGE_TYPES = (
    "CONTAINS DEFINES_METHOD DEFINES_PROPERTY EXTENDS IMPLEMENTS CALLS INSTANTIATES THROWS SOQL_QUERIES SOSL_QUERIES "
    "DML_ON REFERENCES_FIELD REFERENCES_LABEL REFERENCES_METADATA TRIGGERS_ON LWC_USES_APEX LWC_USES_FIELD LWC_USES_LABEL "
    "LWC_USES_RESOURCE LWC_INCLUDES_COMPONENT LWC_TEMPLATE_BINDS AURA_USES_APEX AURA_INCLUDES_COMPONENT "
    "INVOCABLE_FROM_FLOW FLOW_DML_ON FLOW_INVOKES_FLOW FLOW_USES_FIELD LAYOUT_INCLUDES_FIELD LAYOUT_INCLUDES_BUTTON "
    "FLEXIPAGE_INCLUDES_COMPONENT FLEXIPAGE_REFERENCES_FIELD VALIDATION_REFERENCES_FIELD FORMULA_REFERENCES_FIELD "
    "GRANTS_APEX_ACCESS GRANTS_OBJECT_ACCESS GRANTS_FIELD_ACCESS GRANTS_VISUALFORCE_ACCESS GRANTS_RECORDTYPE_ACCESS "
    "INCLUDES_PERMSET EMAIL_REFERENCES_FIELD VF_USES_APEX VF_USES_FIELD VF_INCLUDES_COMPONENT DEPENDS_ON_EXTERNAL"
).split()

#: Confidence tiers; queries take edges of at least DEFAULT_CONFIDENCE unless told otherwise.
RESOLVED, HEURISTIC, REGEX, AMBIGUOUS, UNRESOLVED = 1.0, 0.8, 0.6, 0.4, 0.0
DEFAULT_CONFIDENCE = 0.6

SCHEMA_VERSION = 1

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(columns: str) -> T.StructType:
    """The schema of "name type, ..."; unlike Spark's own reader of such text it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


PROJECTS = _struct("id long, root_path string, name string, indexed_at long, api_version string")
NODES = _struct(
    "id long, project_id long, label string, name string, qualified_name string, file_path string, start_line int, "
    "end_line int, properties string, content_hash string, created_at long, updated_at long"
)
EDGES = _struct(
    "id long, project_id long, source_id long, target_id long, edge_type string, confidence double, properties string, "
    "source_file string, source_line int"
)
FILE_HASHES = _struct("project_id long, file_path string, content_hash string, indexed_at long")
FILE_BACKREFS = _struct("project_id long, target_file string, referring_file string")

#: Fields of an entity that a query may name directly; anything else is looked up in ``properties``.
NODE_FIELDS = ("id", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties", "content_hash")
EDGE_FIELDS = ("id", "source_id", "target_id", "edge_type", "confidence", "properties", "source_file", "source_line")
