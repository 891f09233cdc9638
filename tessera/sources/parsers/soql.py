"""Reads embedded queries: objects and fields with the clause in which they occur. Anything not understood fails the
whole query (None), so that no edge is made up."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s+|(?P<str>'(?:\\.|[^'\\])*')|(?P<bind>:)|(?P<name>[A-Za-z_][\w.]*(?::[A-Za-z_]\w*)?)|(?P<num>[-+]?\d[\w.:+-]*)|(?P<op><=|>=|!=|<>|[=<>(),])")
_CLAUSES = "WHERE WITH GROUP HAVING ORDER LIMIT OFFSET FOR USING ALL UPDATE".split()
_TEXT_OPS = "LIKE IN NOT INCLUDES EXCLUDES".split()


@dataclass
class Soql:
    """``fields``: (object, path, context); the object of a child query is ``Parent>relationship``."""

    object: str
    fields: list[tuple[str, str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    objects: list[str] = field(default_factory=list)


class _Fail(Exception):
    pass


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise _Fail(text[at])
            at = m.end()
            if m.lastgroup == "bind":  # a host expression: to the next top-level word or sign of the query
                m = re.compile(r"\s*[A-Za-z_][\w.]*(?:\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\]]*\])(?:\.[\w.]+)?)*").match(text, at)
                if not m:
                    raise _Fail(":")
                at = m.end()
                self.tokens.append(("bind", m[0]))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.result = 0, None

    def word(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text.upper() if kind == "name" else text if kind in ("op", "end") else kind

    def take(self, *wanted: str) -> bool:
        if self.at < len(self.tokens) and self.word() in wanted:
            self.at += 1
            return True
        return False

    def need(self, *wanted: str) -> None:
        if not self.take(*wanted):
            raise _Fail(self.word())

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise _Fail(self.word())
        self.at += 1
        return self.tokens[self.at - 1][1]

    def add(self, into: list, path: str, context: str, aliases: set[str]) -> None:
        if not (context != "SOQL_SELECT" and path.lower() in aliases):
            into.append((path, context))

    def query(self, parent: str | None = None) -> str:
        """A query from SELECT on, up to its end or an unmatched bracket; returns its object."""
        self.need("SELECT")
        paths: list[tuple[str, str]] = []
        typed: list[tuple[str, str]] = []
        children: list[int] = []
        aliases: set[str] = set()
        while True:
            if self.take("("):
                children.append(self.at)
                self.skip_group()
            elif self.take("TYPEOF"):
                self.name()
                while self.take("WHEN"):
                    kind = self.name()
                    self.need("THEN")
                    typed += [(kind, p) for p in self.names("WHEN", "ELSE", "END")]
                if self.take("ELSE"):
                    self.names("END")
                self.need("END")
            else:
                self.operand(paths, "SOQL_SELECT", aliases)
                if self.tokens[self.at : self.at + 1] and self.tokens[self.at][0] == "name" and self.word() != "FROM":
                    aliases.add(self.name().lower())
            if not self.take(","):
                break
        self.need("FROM")
        obj = self.name()
        prefixes = {obj.lower()}
        if self.take("AS"):
            prefixes.add(self.name().lower())
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.word() not in _CLAUSES:
            prefixes.add(self.name().lower())
        if self.take(","):
            self.result.warnings.append("several objects in FROM")
            self.names(*_CLAUSES)
        whole = f"{parent}>{obj}" if parent else obj
        if self.take("USING"):
            self.need("SCOPE")
            self.name()
        if self.take("WHERE"):
            self.condition(paths, "SOQL_WHERE", aliases)
        while self.take("WITH"):
            self.name()
            while self.at < len(self.tokens) and self.word() not in (*_CLAUSES, ")"):
                self.at += 1
        if self.take("GROUP"):
            self.need("BY")
            self.operands(paths, "SOQL_GROUP_BY", aliases)
            if self.take("HAVING"):
                self.condition(paths, "SOQL_HAVING", aliases)
        if self.take("ORDER"):
            self.need("BY")
            while True:
                self.operand(paths, "SOQL_ORDER_BY", aliases)
                self.take("ASC", "DESC")
                if self.take("NULLS"):
                    self.need("FIRST", "LAST")
                if not self.take(","):
                    break
        for word in ("LIMIT", "OFFSET"):
            if self.take(word):
                self.need("num", "bind")
        while self.take("FOR"):
            self.need("VIEW", "REFERENCE", "UPDATE")
        if self.take("ALL"):
            self.need("ROWS")
        self.result.objects.append(whole)
        seen = {(o.lower(), p.lower(), c) for o, p, c in self.result.fields}
        for path, context in paths:
            first, _, rest = path.partition(".")
            if rest and first.lower() in prefixes:
                path = rest
            if (whole.lower(), path.lower(), context) not in seen:
                seen.add((whole.lower(), path.lower(), context))
                self.result.fields.append((whole, path, context))
        self.result.fields += [(k, p, "SOQL_SELECT") for k, p in typed if (k.lower(), p.lower(), "SOQL_SELECT") not in seen]
        end = self.at
        for at in children:
            self.at = at
            self.query(whole)
            self.need(")")
        self.at = end
        return whole

    def skip_group(self) -> None:
        depth = 1
        while depth:
            if self.at >= len(self.tokens):
                raise _Fail("(")
            depth += {"(": 1, ")": -1}.get(self.word(), 0)
            self.at += 1

    def names(self, *stop: str) -> list[str]:
        out = []
        while self.at < len(self.tokens) and self.word() not in (*stop, ")"):
            if not self.take(","):
                out.append(self.name())
        return out

    def operand(self, paths: list, context: str, aliases: set[str]) -> None:
        path = self.name()
        if not self.take("("):
            self.add(paths, path, context, aliases)
        elif path.upper() == "FIELDS":
            self.result.warnings.append("FIELDS() is not expanded")
            self.skip_group()
        elif not self.take(")"):
            while True:
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
                    self.operand(paths, context, aliases)
                else:
                    self.need("num", "str", "bind")
                if not self.take(","):
                    break
            self.need(")")

    def operands(self, paths: list, context: str, aliases: set[str]) -> None:
        self.operand(paths, context, aliases)
        while self.take(","):
            self.operand(paths, context, aliases)

    def condition(self, paths: list, context: str, aliases: set[str]) -> None:
        while True:
            while self.take("NOT"):
                pass
            if self.take("("):
                self.condition(paths, context, aliases)
                self.need(")")
            else:
                self.operand(paths, context, aliases)
                self.take("NOT")
                self.need("=", "!=", "<>", "<", ">", "<=", ">=", "LIKE", "IN", "INCLUDES", "EXCLUDES")
                if self.take("("):
                    if self.word() == "SELECT":
                        self.query()
                    else:
                        while not self.word() == ")":
                            self.value()
                            self.take(",")
                    self.need(")")
                else:
                    self.value()
            if not self.take("AND", "OR"):
                return

    def value(self) -> None:
        if not self.take("num", "str", "bind"):
            word = self.name()
            if word.upper() in _CLAUSES or word.upper() in ("AND", "OR"):
                raise _Fail(word)


def extract(text: str) -> Soql | None:
    """What the query reads, or None if it isn't understood whole."""
    try:
        reader = _Reader(text)
        reader.result = Soql("")
        reader.result.object = reader.query()
        return reader.result if reader.at == len(reader.tokens) else None
    except _Fail:
        return None
    except IndexError:
        return None


def sosl_objects(text: str) -> list[str]:
    return re.findall(r"RETURNING\s*(\w+)", text, re.I)
