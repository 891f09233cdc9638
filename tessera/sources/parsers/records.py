"""The flat record that parsers emit and resolution joins read."""

from __future__ import annotations

import json

COLUMNS = (
    "rec", "file_path", "label", "name", "qualified_name", "start_line", "end_line", "properties", "edge_type", "confidence",
    "t_label", "t_name", "line", "ref", "text", "arity", "owner",
)
DDL = (
    "rec string, file_path string, label string, name string, qualified_name string, start_line int, end_line int, properties string, edge_type string, "
    "confidence double, t_label string, t_name string, line int, ref string, text string, arity int, owner string"
)


class Records:
    """``node`` rows; ``edge`` rows from (label, qualified_name) to (t_label, t_name); ``ref`` rows, of which ``ref``
    says the kind (extends, implements, new, call, apex, soql) and ``text`` the name; ``warning`` rows."""

    def __init__(self, path: str):
        self.path, self.rows, self.placed = path, [], set()

    def _row(self, rec: str, **values) -> None:
        self.rows.append({c: None for c in COLUMNS} | {"rec": rec, "file_path": self.path} | values)

    def node(self, label: str, qname: str, name: str | None = None, /, *, lines: tuple[int, int] | None = None, **props) -> None:
        first, last = lines or (None, None)
        text = json.dumps({k: v for k, v in props.items() if v is not None}, ensure_ascii=False, sort_keys=True)
        self._row("node", label=label, qualified_name=qname, name=name or qname.rsplit(".", 1)[-1], start_line=first, end_line=last, properties=text)

    def placeholder(self, label: str, qname: str) -> None:
        """A node that is only known by reference; a real one of its name takes its place. Once a file."""
        if (label, qname) not in self.placed:
            self.placed.add((label, qname))
            self.node(label, qname, isPlaceholder=True, firstSeenIn=self.path)

    def edge(self, label: str, qname: str, kind: str, t_label: str, t_name: str, confidence: float = 1.0, line: int | None = None, **props) -> None:
        text = json.dumps({k: v for k, v in props.items() if v is not None}, ensure_ascii=False, sort_keys=True)
        self._row("edge", label=label, qualified_name=qname, edge_type=kind, t_label=t_label, t_name=t_name, confidence=confidence, line=line, properties=text)

    def ref(self, kind: str, label: str, qname: str, text: str, arity: int | None = None, owner: str | None = None, line: int | None = None, **props) -> None:
        self._row("ref", ref=kind, label=label, qualified_name=qname, text=text, arity=arity, owner=owner, line=line, properties=json.dumps(props, sort_keys=True))

    def warn(self, text: str, line: int | None = None) -> None:
        self._row("warning", text=text, line=line)
