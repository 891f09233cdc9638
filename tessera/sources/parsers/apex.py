"""Apex classes, interfaces, enums and triggers."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from tessera import model
from tessera.sources.parsers import soql
from tessera.sources.parsers.records import Records

_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<op>.)", re.S)
_QUERY = re.compile(r"\[\s*(SELECT|FIND)\b", re.I)
# Words that look like calls or members and are not.
_CONTROL = frozenset("if for while switch catch return else do try finally throw when on instanceof super this insert update delete upsert undelete merge".split())
_MODIFIERS = frozenset("public private protected global static final abstract virtual override transient webservice testmethod with without inherited sharing".split())


@dataclass
class Tok:
    kind: str
    text: str
    line: int

    @property
    def low(self) -> str:
        return self.text.lower()


def tokens_of(source: str) -> list[Tok]:
    """Tokens without comments; a bracketed query is one token."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out, at = [], 0
    while at < len(source):
        line = bisect_right(starts, at)
        if source[at] == "[" and _QUERY.match(source, at):
            end, depth, quoted = at, 0, False
            while end < len(source):
                c = source[end]
                if quoted:
                    end += c == "\\"
                    quoted = c != "'"
                elif c == "'":
                    quoted = True
                else:
                    depth += (c == "[") - (c == "]")
                end += 1
                if not depth:
                    break
            out.append(Tok("query", source[at + 1 : end - 1], line))
            at = end
            continue
        m = _TOKEN.match(source, at)
        if m.lastgroup != "skip":
            out.append(Tok(m.lastgroup, m[0], line))
        at = m.end()
    return out


class _Unit:
    def __init__(self, out: Records, source: str):
        self.out, self.toks, self.at = out, tokens_of(source), 0

    def peek(self, ahead: int = 0) -> Tok:
        i = self.at + ahead
        return self.toks[i] if i < len(self.toks) else Tok("end", "", self.toks[-1].line if self.toks else 1)

    def group(self, opening: str, closing: str) -> list[Tok]:
        """Tokens between the bracket at hand and its match; stops behind the match."""
        start, depth = self.at + 1, 0
        while self.at < len(self.toks):
            depth += {opening: 1, closing: -1}.get(self.toks[self.at].text, 0)
            self.at += 1
            if not depth:
                return self.toks[start : self.at - 1]
        raise ValueError(f"unmatched {opening}")

    def modifiers(self) -> tuple[list[str], set[str]]:
        """(annotations, modifiers in lower case) before a declaration."""
        marks, words = [], set()
        while True:
            if self.peek().text == "@" and self.peek(1).kind == "name":
                marks.append(self.peek(1).text)
                self.at += 2
                if self.peek().text == "(":
                    self.group("(", ")")
            elif self.peek().low in _MODIFIERS and self.peek().kind == "name":
                words.add(self.peek().low)
                self.at += 1
            else:
                return marks, words

    def type_name(self) -> str | None:
        """A type's simple text without generics, or None; stops behind it."""
        if self.peek().kind != "name":
            return None
        text = self.peek().text
        self.at += 1
        while self.peek().text == "." and self.peek(1).kind == "name":
            text += "." + self.peek(1).text
            self.at += 2
        if self.peek().text == "<":
            depth = 0
            while self.peek().kind != "end":
                depth += {"<": 1, ">": -1}.get(self.peek().text, 0)
                self.at += 1
                if not depth:
                    break
        while self.peek().text == "[" and self.peek(1).text == "]":
            self.at += 2
            text += "[]"
        return text

    def names_until(self, *stops: str) -> list[str]:
        out = []
        while self.peek().text != "{" and self.peek().low not in stops:
            if self.peek().kind == "end":
                raise ValueError("unexpected end")
            if self.peek().text == ",":
                self.at += 1
            elif (n := self.type_name()) is not None:
                out.append(n)
            else:
                self.at += 1
        return out

    # declarations

    def unit(self) -> None:
        marks, words = self.modifiers()
        if self.peek().low == "trigger":
            self.trigger()
        else:
            self.declaration(None, marks, words)

    def trigger(self) -> None:
        first = self.peek().line
        name, obj = self.peek(1).text, self.peek(3).text
        if self.peek(2).low != "on":
            raise ValueError("trigger without object")
        self.at += 4
        events = [" ".join(t.low for t in e) for e in _split(self.group("(", ")"))]
        body = self.group("{", "}")
        self.out.node("ApexTrigger", name, lines=(first, self.toks[self.at - 1].line), events=events, sObject=obj)
        self.out.placeholder("SObject", obj)
        self.out.edge("ApexTrigger", name, "TRIGGERS_ON", "SObject", obj, line=first, events=events)
        self.body("ApexTrigger", name, name, body)

    def declaration(self, outer: str | None, marks: list[str], words: set[str]) -> None:
        kind, first = self.peek().low, self.peek().line
        if kind not in ("class", "interface", "enum"):
            raise ValueError(f"unexpected {self.peek().text!r}")
        name = self.peek(1).text
        self.at += 2
        qname = f"{outer}.{name}" if outer else name
        label = {"class": "ApexClass", "interface": "ApexInterface", "enum": "ApexEnum"}[kind]
        if self.peek().text == "<":
            self.at -= 1
            self.type_name()
        if self.peek().low == "extends":
            self.at += 1
            for base in self.names_until("implements"):
                self.out.ref("extends", label, qname, base, line=first)
        if self.peek().low == "implements":
            self.at += 1
            for base in self.names_until():
                self.out.ref("implements", label, qname, base, line=first)
        if self.peek().text != "{":
            raise ValueError(f"expected a body of {qname}")
        start = self.at
        inside = self.group("{", "}")
        end, last = self.at, self.toks[self.at - 1].line
        if "sharing" in words:
            sharing = next((w for w in ("inherited", "with", "without") if w in words), "inherited")
        else:
            sharing = "inherited"
        props = {"annotations": marks}
        if kind == "class":
            low = {m.lower() for m in marks}
            props |= {"sharing": sharing, "isAbstract": "abstract" in words, "isVirtual": "virtual" in words, "isTest": "istest" in low}
        if kind == "enum":
            props["values"] = [t.text for t in inside if t.kind == "name"]
        self.out.node(label, qname, name, lines=(first, last), **props)
        if kind == "class":
            self.at = start + 1
            while self.at < end - 1:
                self.member(qname, name)
            self.at = end

    def member(self, owner: str, short: str) -> None:
        if self.peek().text == ";":
            self.at += 1
            return
        marks, words = self.modifiers()
        if self.peek().low in ("class", "interface", "enum") and self.peek(1).kind == "name":
            return self.declaration(owner, marks, words)
        if self.peek().text == "{":  # initializer
            self.body("ApexClass", owner, owner, self.group("{", "}"))
            return None
        first = self.peek().line
        if self.peek().low == short.lower() and self.peek(1).text == "(":
            name, result = self.peek().text, None
            self.at += 1
        else:
            result = self.type_name()
            if result is None or self.peek().kind != "name":
                raise ValueError(f"unexpected {self.peek().text!r} in {owner} at line {self.peek().line}")
            name = self.peek().text
            self.at += 1
        if self.peek().text == "(":
            return self.method(owner, name, result, marks, words, first)
        fields = [name]
        is_variable = self.peek().text != "{"
        if is_variable:
            expr: list[Tok] = []
            depth = 0
            while self.peek().text != ";" or depth:
                t = self.peek()
                if t.kind == "end":
                    raise ValueError("unexpected end")
                depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "op" else 0
                if t.text == "," and not depth and self.peek(1).kind == "name" and self.peek(2).text in (";", ",", "="):
                    fields.append(self.peek(1).text)
                expr.append(t)
                self.at += 1
            self.at += 1
        else:
            self.group("{", "}")
        for f in fields:
            qname = f"{owner}.{f}"
            self.out.node("ApexProperty", qname, f, lines=(first, self.toks[self.at - 1].line), type=result, isStatic="static" in words, isMemberVariable=is_variable, annotations=marks)
            self.out.edge("ApexClass", owner, "DEFINES_PROPERTY", "ApexProperty", qname)
        return None

    def method(self, owner: str, name: str, result: str | None, marks: list[str], words: set[str], first: int) -> None:
        params = []
        for p in _split(self.group("(", ")")):
            p = [t for t in p if t.low != "final"]
            text = "".join(t.text for t in p[:-1])
            params.append(re.sub(r"<.*>", "", text))
        simple = [p.rsplit(".", 1)[-1] for p in params]
        qname = f"{owner}.{name}({', '.join(simple)})"
        body = self.group("{", "}") if self.peek().text == "{" else []
        if not body and self.peek().text == ";":
            self.at += 1
        low = {m.lower() for m in marks}
        self.out.node(
            "ApexMethod", qname, name, lines=(first, self.toks[self.at - 1].line), returnType=result, isConstructor=result is None, isStatic="static" in words,
            parameters=[{"type": p} for p in params], annotations=marks, isAuraEnabled="auraenabled" in low, isInvocable="invocablemethod" in low,
            isTest="istest" in low or "testmethod" in words, ownerClass=owner, arity=len(params),
        )
        self.out.edge("ApexClass", owner, "DEFINES_METHOD", "ApexMethod", qname)
        self.body("ApexMethod", qname, owner, body)

    # bodies

    def body(self, label: str, qname: str, owner: str, toks: list[Tok]) -> None:
        for i, t in enumerate(toks):
            after = toks[i + 1] if i + 1 < len(toks) else None
            if t.kind == "query":
                self.query(label, qname, t)
            elif t.kind != "name" or after is None:
                continue
            elif t.low == "new":
                j, name = i + 2, after.text
                while j + 1 < len(toks) and toks[j].text == "." and toks[j + 1].kind == "name":
                    name, j = f"{name}.{toks[j + 1].text}", j + 2
                if j < len(toks) and toks[j].text == "(":
                    self.out.ref("new", label, qname, name, _count(toks, j), owner, t.line)
            elif after.text == "(" and t.low not in _CONTROL:
                receiver, k = [], i - 1
                while k > 0 and toks[k].text == "." and (toks[k - 1].kind == "name" or toks[k - 1].text == ")"):
                    if toks[k - 1].text == ")":
                        receiver = ["?"]
                        break
                    receiver.insert(0, toks[k - 1].text)
                    k -= 2
                if k >= 0 and toks[k].kind == "name" and toks[k].low == "new" and not receiver:
                    continue
                if receiver and k >= 0 and toks[k].low == "new":
                    continue
                whole = ".".join(receiver)
                if whole.lower() == "database" and t.low.startswith("query") or whole.lower() == "database" and t.low == "getquerylocator":
                    if i + 2 < len(toks) and toks[i + 2].kind not in ("str", "query"):
                        self.out.warn(f"dynamic query in {qname}", t.line)
                self.out.ref("call", label, qname, f"{whole}.{t.text}" if whole else t.text, _count(toks, i + 1), owner, t.line)

    def query(self, label: str, qname: str, t: Tok) -> None:
        if re.match(r"\s*FIND\b", t.text, re.I):
            for obj in soql.sosl_objects(t.text):
                self.out.placeholder("SObject", obj)
                self.out.edge("ApexMethod", qname, "SOSL_QUERIES", "SObject", obj, model.REGEX, t.line)
            return
        found = soql.extract(t.text)
        if found is None:
            self.out.warn(f"query not understood in {qname}", t.line)
            return
        for w in found.warnings:
            self.out.warn(f"{w} in {qname}", t.line)
        for obj in found.objects:
            if ">" not in obj:
                self.out.placeholder("SObject", obj)
                self.out.edge(label, qname, "SOQL_QUERIES", "SObject", obj, line=t.line)
            else:
                self.out.ref("soql_object", label, qname, obj, line=t.line)
        for obj, path, context in found.fields:
            if ">" in obj or "." in path:
                self.out.ref("soql", label, qname, f"{obj}|{path}", line=t.line, context=context)
            else:
                self.out.edge(label, qname, "REFERENCES_FIELD", "Field", f"{obj}.{path}", line=t.line, context=context)


def _split(toks: list[Tok]) -> list[list[Tok]]:
    out, depth, now = [], 0, []
    for t in toks:
        depth += (t.text in ("(", "<", "[")) - (t.text in (")", ">", "]"))
        if t.text == "," and not depth:
            out.append(now)
            now = []
        else:
            now.append(t)
    return [*out, now] if now else out


def _count(toks: list[Tok], at: int) -> int:
    """Arguments in the bracket at ``at``."""
    depth, commas, some = 0, 0, False
    for t in toks[at:]:
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}")) if t.kind == "op" else 0
        if not depth:
            break
        some = some or t.text != "("
        commas += t.text == "," and depth == 1
    return commas + 1 if some else 0


def parse_apex(out: Records, path: str, parent: str | None, files: list[tuple[str, str]]) -> None:
    _Unit(out, files[0][1]).unit()


PARSERS = {"apex_class": parse_apex, "apex_trigger": parse_apex}
