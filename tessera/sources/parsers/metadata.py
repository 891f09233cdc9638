"""Metadata files in XML: objects, fields, rules, labels, grants, pages, layouts, flows, e-mail templates."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from tessera import model
from tessera.sources.parsers.records import Records

# Functions and constants of formulas, which are not fields.
FORMULA_WORDS = frozenset(
    "and or not if case isblank isnull isnew ischanged ispickval includes priorvalue text value len left right mid trim upper lower substitute contains begins "
    "find regex concatenate date datevalue datetimevalue today now year month day weekday addmonths hour minute second round floor ceiling abs max min mod sqrt exp ln log "
    "power nullvalue blankvalue br hyperlink image url vlookup getsessionid currencyrate casesafeid isclone isnumber true false null".split()
)
_CHAIN = re.compile(r"\$?[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*")
_STANDARD = ("__c", "__mdt")


def formula_references(formula: str, parent: str | None) -> list[str]:
    """Names in a formula: a lone one belongs to ``parent``, a dotted one stays. Strings aren't skipped."""
    out = []
    for m in _CHAIN.finditer(formula or ""):
        chain = re.sub(r"\s", "", m[0])
        before = formula[: m.start()].rstrip()[-1:]
        if before == "." or "." not in chain and (chain.lower() in FORMULA_WORDS or chain.startswith("$")):
            continue
        if "." not in chain:
            chain = f"{parent}.{chain}" if parent else chain
        out.append(chain)
    return list(dict.fromkeys(out))


class Xml:
    """An element without its namespaces."""

    def __init__(self, element: ET.Element):
        self.element = element

    @staticmethod
    def of(text: str) -> Xml:
        return Xml(ET.fromstring(text.encode() if text.lstrip().startswith("<?xml") else text))

    def all(self, tag: str) -> list[Xml]:
        return [Xml(e) for e in self.element if e.tag.rsplit("}", 1)[-1] == tag]

    def one(self, path: str) -> Xml | None:
        now = self
        for tag in path.split("."):
            got = now.all(tag)
            if not got:
                return None
            now = got[0]
        return now

    def text(self, path: str = "") -> str | None:
        e = self.one(path) if path else self
        return (e.element.text or "").strip() if e is not None else None

    def flag(self, path: str) -> bool:
        return self.text(path) == "true"

    def walk(self):
        for e in self.element.iter():
            yield e.tag.rsplit("}", 1)[-1], (e.text or "").strip()


def _stem(path: str, suffix: str) -> str:
    return os.path.basename(path).removesuffix(suffix)


def parse_object(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".object-meta.xml")
    out.node("SObject", name, label=x.text("label"), pluralLabel=x.text("pluralLabel"), sharingModel=x.text("sharingModel"), deploymentStatus=x.text("deploymentStatus"), nameFieldType=x.text("nameField.type"), isCustom=name.endswith(_STANDARD))


def parse_field(out: Records, path: str, parent: str | None, files) -> None:
    x = Xml.of(files[0][1])
    name = x.text("fullName") or _stem(path, ".field-meta.xml")
    values = [v.text("fullName") for v in (x.one("valueSet.valueSetDefinition").all("value") if x.one("valueSet.valueSetDefinition") else [])]
    q = f"{parent}.{name}"
    out.node("Field", q, name, label=x.text("label"), type=x.text("type"), length=x.text("length"), required=x.flag("required"), unique=x.flag("unique"), externalId=x.flag("externalId"), formula=x.text("formula"), referenceTo=x.text("referenceTo"), relationshipName=x.text("relationshipName"), summaryOperation=x.text("summaryOperation"), picklistValues=values or None, isCustom=name.endswith("__c"), sObject=parent)
    if x.text("summarizedField"):
        out.edge("Field", q, "FORMULA_REFERENCES_FIELD", "Field", x.text("summarizedField"), model.HEURISTIC)


def parse_rule(out: Records, path: str, parent: str | None, files) -> None:
    x = Xml.of(files[0][1])
    name = x.text("fullName") or _stem(path, ".validationRule-meta.xml")
    q = f"{parent}.{name}"
    formula = x.text("errorConditionFormula") or ""
    out.node("ValidationRule", q, name, active=x.flag("active"), formula=formula, errorMessage=x.text("errorMessage"), errorDisplayField=x.text("errorDisplayField"), sObject=parent)
    for ref in formula_references(formula, parent):
        out.edge("ValidationRule", q, "VALIDATION_REFERENCES_FIELD", "Field", ref, model.REGEX)


def parse_record_type(out: Records, path: str, parent: str | None, files) -> None:
    x = Xml.of(files[0][1])
    name = x.text("fullName") or _stem(path, ".recordType-meta.xml")
    out.node("RecordType", f"{parent}.{name}", name, active=x.flag("active"), label=x.text("label"), sObject=parent)


def parse_labels(out: Records, path: str, parent: str | None, files) -> None:
    for x in Xml.of(files[0][1]).all("labels"):
        name = x.text("fullName")
        out.node("CustomLabel", f"c.{name}", name, value=x.text("value"), language=x.text("language") or "en_US", isProtected=x.flag("protected"))


# Grant lists of permission sets and profiles: tag, name tag, target label, edge type, flags.
_GRANTS = (
    ("classAccesses", "apexClass", "ApexClass", "GRANTS_APEX_ACCESS", ("enabled",)),
    ("objectPermissions", "object", "SObject", "GRANTS_OBJECT_ACCESS", ("allowCreate", "allowRead", "allowEdit", "allowDelete", "viewAllRecords", "modifyAllRecords")),
    ("fieldPermissions", "field", "Field", "GRANTS_FIELD_ACCESS", ("readable", "editable")),
    ("pageAccesses", "apexPage", "VisualforcePage", "GRANTS_VISUALFORCE_ACCESS", ("enabled",)),
    ("recordTypeVisibilities", "recordType", "RecordType", "GRANTS_RECORDTYPE_ACCESS", ("visible", "default")),
)


def _grants(label: str, suffix: str):
    def parse(out: Records, path: str, parent: str | None, files) -> None:
        x, name = Xml.of(files[0][1]), _stem(path, suffix)
        users = [{"name": u.text("name"), "enabled": u.flag("enabled")} for u in x.all("userPermissions")]
        out.node(label, name, label=x.text("label"), description=x.text("description"), userPermissions=users or None)
        for tag, of, target, kind, flags in _GRANTS:
            for g in x.all(tag):
                if g.text(of):
                    out.edge(label, name, kind, target, g.text(of), **{f: g.flag(f) for f in flags})

    return parse


def parse_group(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".permissionsetgroup-meta.xml")
    out.node("PermissionSetGroup", name, label=x.text("label"), description=x.text("description"), status=x.text("status"))
    for member in x.all("permissionSets"):
        out.edge("PermissionSetGroup", name, "INCLUDES_PERMSET", "PermissionSet", member.text())


def parse_flexipage(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".flexipage-meta.xml")
    obj = x.text("sobjectType")
    out.node("FlexiPage", name, label=x.text("masterLabel"), type=x.text("type"), sObject=obj)
    seen = set()

    def whole(field: str) -> str:
        return f"{obj}.{field.removeprefix('Record.')}" if obj and (field.startswith("Record.") or "." not in field) else field

    for tag, text in x.walk():
        if tag == "componentName" and text.startswith("c:") and text not in seen:
            seen.add(text)
            for target in ("LwcBundle", "AuraBundle"):  # whichever exists stays
                out.edge("FlexiPage", name, "FLEXIPAGE_INCLUDES_COMPONENT", target, text[2:], model.HEURISTIC)
        elif tag == "fieldItem":
            out.edge("FlexiPage", name, "FLEXIPAGE_REFERENCES_FIELD", "Field", whole(text))
        elif tag in ("value", "leftValue", "fieldName"):
            for ref in re.findall(r"\bRecord\.(\w+)", text):
                out.edge("FlexiPage", name, "FLEXIPAGE_REFERENCES_FIELD", "Field", whole(f"Record.{ref}"), model.REGEX)


def parse_layout(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".layout-meta.xml")
    obj = name.split("-")[0]
    out.node("Layout", name, name, sObject=obj)
    for section in x.all("layoutSections"):
        for column in section.all("layoutColumns"):
            for item in column.all("layoutItems"):
                if item.text("field") and not item.flag("emptySpace"):
                    out.edge("Layout", name, "LAYOUT_INCLUDES_FIELD", "Field", f"{obj}.{item.text('field')}", behavior=item.text("behavior"), section=section.text("label"))


_FLOW_DML = {"recordCreates": "insert", "recordUpdates": "update", "recordDeletes": "delete", "recordLookups": "select"}


def parse_flow(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".flow-meta.xml")
    obj = x.text("start.object")
    out.node("Flow", name, label=x.text("label"), processType=x.text("processType"), status=x.text("status"), triggerType=x.text("start.triggerType"), sObject=obj)
    if obj and x.text("start.triggerType"):
        out.edge("Flow", name, "FLOW_DML_ON", "SObject", obj, operation="trigger", triggerType=x.text("start.triggerType"), recordTriggerType=x.text("start.recordTriggerType"))
    for call in x.all("actionCalls"):
        if call.text("actionType") == "apex" and call.text("actionName"):
            out.edge("Flow", name, "INVOCABLE_FROM_FLOW", "ApexClass", call.text("actionName"), model.HEURISTIC, element=call.text("name"))
    for sub in x.all("subflows"):
        if sub.text("flowName"):
            out.edge("Flow", name, "FLOW_INVOKES_FLOW", "Flow", sub.text("flowName"), element=sub.text("name"))
    types = {v.text("name"): v.text("objectType") for v in x.all("variables") if v.text("objectType")}
    if obj:
        types |= {"$Record": obj, "$Record__Prior": obj}
    for r in x.all("recordLookups"):
        if r.text("object"):
            if r.flag("storeOutputAutomatically"):
                types[r.text("name")] = r.text("object")
            if r.text("outputReference"):
                types[r.text("outputReference")] = r.text("object")
    seen: set[tuple] = set()

    def use(field: str, element: str | None, context: str, confidence: float = 1.0) -> None:
        if (field, element, context) not in seen:
            seen.add((field, element, context))
            out.edge("Flow", name, "FLOW_USES_FIELD", "Field", field, confidence, element=element, context=context)

    def refer(text: str, element: str | None, context: str, confidence: float = 1.0) -> None:
        parts = text.split(".")
        if len(parts) == 2 and types.get(parts[0]):
            use(f"{types[parts[0]]}.{parts[1]}", element, context, confidence)
        elif len(parts) > 1:
            out.warn(f"flow reference {text!r} is not resolved")

    for tag, operation in _FLOW_DML.items():
        for r in x.all(tag):
            target = r.text("object") or types.get(r.text("inputReference") or "")
            if not target:
                continue
            element = r.text("name")
            out.edge("Flow", name, "FLOW_DML_ON", "SObject", target, operation=operation, element=element)
            for f in r.all("filters"):
                use(f"{target}.{f.text('field')}", element, "filter")
            for f in r.all("inputAssignments"):
                use(f"{target}.{f.text('field')}", element, "assignment")
            for f in r.all("queriedFields"):
                use(f"{target}.{f.text()}", element, "query")
            for f in r.all("outputAssignments"):
                use(f"{target}.{f.text('field')}", element, "output")
    for element in x.element:
        e = Xml(element)
        tag = element.tag.rsplit("}", 1)[-1]
        for inner, text in e.walk():
            if inner in ("elementReference", "leftValueReference", "assignToReference"):
                refer(text, e.text("name"), inner)
            elif inner == "expression" and tag == "formulas":
                bare = re.sub(r"'[^']*'|\"[^\"]*\"", "", text)
                for ref in re.findall(r"\{!([$\w.]+)\}", bare):
                    refer(ref, e.text("name"), "formula", model.REGEX)


def parse_resource(out: Records, path: str, parent: str | None, files) -> None:
    x = Xml.of(files[0][1])
    out.node("StaticResource", _stem(path, ".resource-meta.xml"), contentType=x.text("contentType"), cacheControl=x.text("cacheControl"))


def parse_email(out: Records, path: str, parent: str | None, files) -> None:
    x, name = Xml.of(files[0][1]), _stem(path, ".email-meta.xml")
    q = f"{parent}/{name}" if parent else name
    subject = x.text("subject") or ""
    out.node("EmailTemplate", q, name, label=x.text("name"), subject=subject, type=x.text("type"), folder=parent)
    text = " ".join([subject, *(body for _, body in files[1:])])
    fields = re.findall(r"\{!\s*([A-Za-z]\w*\.[A-Za-z]\w*)\s*\}", text)
    labels = re.findall(r"\{!\s*\$Label\.(?:c\.)?(\w+)\s*\}", text)
    for f in dict.fromkeys(fields):
        out.edge("EmailTemplate", q, "EMAIL_REFERENCES_FIELD", "Field", f, model.REGEX)
    for name_ in dict.fromkeys(labels):
        out.edge("EmailTemplate", q, "REFERENCES_LABEL", "CustomLabel", f"c.{name_}", model.REGEX)


PARSERS = {
    "object": parse_object, "field": parse_field, "validation_rule": parse_rule, "record_type": parse_record_type, "labels": parse_labels,
    "permission_set": _grants("PermissionSet", ".permissionset-meta.xml"), "profile": _grants("Profile", ".profile-meta.xml"), "permission_set_group": parse_group,
    "flexipage": parse_flexipage, "layout": parse_layout, "flow": parse_flow, "static_resource": parse_resource, "email_template": parse_email,
}
