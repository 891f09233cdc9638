"""Component bundles and pages: LWC, Aura, Visualforce."""

from __future__ import annotations

import os
import re

from tessera import model
from tessera.sources.parsers.records import Records

_TAG = re.compile(r"<([a-zA-Z][\w]*)([:-])([\w-]+)((?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|\{[^}]*\}))?)*)\s*/?>")
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_IMPORT = re.compile(r"import\s+(?:[\w$*{}\s,]+?\s+from\s+)?['\"]@salesforce/(\w+)/([^'\"]+)['\"]")


def _camel(kebab: str) -> str:
    return re.sub(r"-(\w)", lambda m: m[1].upper(), kebab)


def parse_lwc(out: Records, path: str, parent: str | None, files: list[tuple[str, str]]) -> None:
    """Modules' imports of methods, fields, labels and resources; templates' child components."""
    bundle = os.path.basename(path.rstrip("/"))
    out.node("LwcBundle", bundle, files=[n for n, _ in files])
    for name, text in files:
        if name.endswith(".html"):
            out.node("LwcTemplate", f"{bundle}/{name}", name)
            for child in dict.fromkeys(_camel(m[3]) for m in _TAG.finditer(text) if m[1] == "c" and m[2] == "-"):
                out.edge("LwcBundle", bundle, "LWC_INCLUDES_COMPONENT", "LwcBundle", child)
        elif name.endswith((".js", ".ts")):
            out.node("LwcModule", f"{bundle}/{name}", name)
            for m in _IMPORT.finditer(text):
                scope, target, line = m[1], m[2], text.count("\n", 0, m.start()) + 1
                if scope == "apex" or scope == "apexContinuation":
                    out.ref("apex", "LwcBundle", bundle, target, line=line, edge="LWC_USES_APEX", confidence=model.HEURISTIC)
                elif scope == "schema":
                    label = "Field" if "." in target else "SObject"
                    out.edge("LwcBundle", bundle, "LWC_USES_FIELD" if label == "Field" else "REFERENCES_FIELD", label, target, line=line)
                elif scope == "label":
                    out.edge("LwcBundle", bundle, "LWC_USES_LABEL", "CustomLabel", target, line=line)
                elif scope == "resourceUrl":
                    out.edge("LwcBundle", bundle, "LWC_USES_RESOURCE", "StaticResource", target.split("/")[0], line=line)


_AURA_ORDER = (".cmp", ".app", ".evt", ".intf", "Controller.js", "Helper.js")


def parse_aura(out: Records, path: str, parent: str | None, files: list[tuple[str, str]]) -> None:
    """Markup first, then controller and helper: server calls need the controller's class."""
    bundle = os.path.basename(path.rstrip("/"))
    out.node("AuraBundle", bundle, files=[n for n, _ in files])
    controller, children = None, {}
    for name, text in sorted(files, key=lambda f: next((i for i, s in enumerate(_AURA_ORDER) if f[0].endswith(s)), 9)):
        if name.endswith((".cmp", ".app")):
            out.node("AuraComponent", f"{bundle}/{name}", name)
            m = re.search(r"<aura:(?:component|application)\b[^>]*?\bcontroller\s*=\s*[\"']([\w.]+)[\"']", text, re.S)
            if m:
                controller = m[1]
                out.edge("AuraBundle", bundle, "AURA_USES_APEX", "ApexClass", controller)
            for t in _TAG.finditer(text):
                if t[1] == "c" and t[2] == ":":
                    children.setdefault(t[3], 1.0)
            for d in re.findall(r"<aura:dependency\b[^>]*\bresource\s*=\s*[\"'](?:markup://)?c:(\w+)[\"']", text):
                children.setdefault(d, model.HEURISTIC)
        elif name.endswith(("Controller.js", "Helper.js")):
            out.node("AuraController" if name.endswith("Controller.js") else "AuraHelper", f"{bundle}/{name}", name)
            for m in re.finditer(r"\.get\(\s*[\"']c\.(\w+)[\"']\s*\)", text):
                line = text.count("\n", 0, m.start()) + 1
                out.ref("apex", "AuraBundle", bundle, f"{controller}.{m[1]}" if controller else m[1], line=line, edge="AURA_USES_APEX", confidence=model.HEURISTIC if controller else model.AMBIGUOUS)
    for child, confidence in children.items():
        for label in ("AuraBundle", "LwcBundle"):  # whichever exists stays
            out.edge("AuraBundle", bundle, "AURA_INCLUDES_COMPONENT", label, child, confidence)


def _visualforce(label: str, suffix: str):
    def parse(out: Records, path: str, parent: str | None, files: list[tuple[str, str]]) -> None:
        text, name = files[0][1], os.path.basename(path).removesuffix(suffix)
        head = re.search(r"<apex:(?:page|component)\b([^>]*)>", text, re.S)
        attributes = {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _ATTRIBUTE.finditer(head[1])} if head else {}
        out.node(label, name, controller=attributes.get("controller"), standardController=attributes.get("standardcontroller"), extensions=attributes.get("extensions"))
        classes = [attributes.get("controller")] + [e.strip() for e in (attributes.get("extensions") or "").split(",")]
        for c in dict.fromkeys(c for c in classes if c):
            out.edge(label, name, "VF_USES_APEX", "ApexClass", c)
        for child in dict.fromkeys(m[3] for m in _TAG.finditer(text) if m[1] == "c" and m[2] == ":"):
            out.edge(label, name, "VF_INCLUDES_COMPONENT", "VisualforceComponent", child)
        for page in dict.fromkeys(re.findall(r"<apex:include\b[^>]*\bpageName\s*=\s*[\"'](\w+)[\"']", text)):
            out.edge(label, name, "VF_INCLUDES_COMPONENT", "VisualforcePage", page)
        for chain in dict.fromkeys(re.findall(r"=\s*[\"']\{!\s*([A-Za-z]\w*(?:\.\w+)+)\s*\}[\"']", text)):
            out.edge(label, name, "VF_USES_FIELD", "Field", chain, model.REGEX)

    return parse


PARSERS = {"lwc": parse_lwc, "aura": parse_aura, "vf_page": _visualforce("VisualforcePage", ".page"), "vf_component": _visualforce("VisualforceComponent", ".component")}
