"""Syntax tree of the Cypher subset, and the parser that builds it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.plans.errors import CypherError
from tessera.plans.lexer import Token, tokenize


@dataclass(frozen=True)
class NodePattern:
    variable: str | None
    label: str | None
    column: int = 0


@dataclass(frozen=True)
class EdgePattern:
    variable: str | None
    type: str | None
    column: int = 0


@dataclass(frozen=True)
class Pattern:
    """One node, or an edge from ``source`` to ``target``; ``left`` is the node that was written first."""

    source: NodePattern
    edge: EdgePattern | None = None
    target: NodePattern | None = None
    backwards: bool = False


@dataclass(frozen=True)
class Access:
    """``variable`` or ``variable.property``."""

    variable: str
    property: str | None
    column: int = 0

    @property
    def name(self) -> str:
        return f"{self.variable}.{self.property}" if self.property else self.variable


@dataclass(frozen=True)
class Test:
    """One comparison. ``op``: =, IN, CONTAINS, STARTS WITH, ENDS WITH, IS NULL or IS NOT NULL."""

    access: Access
    op: str
    value: object = None


@dataclass(frozen=True)
class Junction:
    op: str  # AND or OR
    parts: tuple


@dataclass(frozen=True)
class Item:
    """A projected thing: an access, a count (of an access or of rows), or all variables."""

    kind: str  # access, count or all
    access: Access | None = None
    alias: str | None = None
    column: int = 0

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.kind == "count":
            return f"count({self.access.name if self.access else '*'})"
        return self.access.name


@dataclass(frozen=True)
class Projection:
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[Access, bool] | None = None  # the key, and whether descending
    skip: int | None = None
    limit: int | None = None
    where: object = None


@dataclass(frozen=True)
class Match:
    pattern: Pattern
    optional: bool
    where: object = None


@dataclass(frozen=True)
class With:
    projection: Projection


@dataclass(frozen=True)
class Query:
    clauses: tuple = field(default_factory=tuple)
    result: Projection | None = None


# What the language leaves out, with what to tell the user.
_REJECTED = (
    (r"\bUNWIND\b", "UNWIND is not supported", "Use IN [...] in WHERE instead."),
    (r"\[[^\]]*\*[^\]]*\]", "Variable-length paths are not supported", "Use trace_references for bounded traversals."),
    (r"\b(CREATE|MERGE|DELETE|SET|REMOVE)\b", "Write clauses are not supported", "Queries are read-only."),
    (r"\b(COLLECT|SUM|MIN|MAX|AVG)\s*\(", "Only count() aggregates are supported", "Use count(*) or count(variable)."),
    (r"\bCALL\b", "CALL is not supported", "Use MATCH patterns only."),
)


def reject_unsupported(text: str) -> None:
    bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "''", text, flags=re.S)
    for pattern, message, suggestion in _REJECTED:
        if re.search(pattern, bare, re.I):
            raise CypherError(message, suggestion=suggestion)


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def step(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def fail(self, wanted: str):
        raise CypherError(f"Expected {wanted}, found {self.now.value or 'end of query'!r}", self.now.column)

    def word(self, *words: str) -> bool:
        """Takes the keyword if it comes next."""
        if self.now.says(*words):
            self.step()
            return True
        return False

    def sign(self, sign: str) -> bool:
        if self.now.signs(sign):
            self.step()
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    def need_sign(self, sign: str) -> None:
        if not self.sign(sign):
            self.fail(repr(sign))

    def name(self, what: str = "a name") -> str:
        if self.now.kind != "name":
            self.fail(what)
        return str(self.step().value)

    # clauses

    def query(self) -> Query:
        clauses = [self.match()]
        while not self.now.says("RETURN"):
            if self.word("WITH"):
                clauses.append(With(self.projection(is_with=True)))
            elif self.now.says("MATCH", "OPTIONAL"):
                clauses.append(self.match())
            else:
                self.fail("MATCH, OPTIONAL MATCH, WITH or RETURN")
        self.step()
        result = self.projection(is_with=False)
        if self.now.kind != "end":
            self.fail("end of query")
        return Query(tuple(clauses), result)

    def match(self) -> Match:
        optional = self.word("OPTIONAL")
        self.need_word("MATCH")
        pattern = self.pattern()
        return Match(pattern, optional, self.predicate() if self.word("WHERE") else None)

    def node(self) -> NodePattern:
        column = self.now.column
        self.need_sign("(")
        variable = self.name() if self.now.kind == "name" else None
        label = self.name("a label") if self.sign(":") else None
        self.need_sign(")")
        return NodePattern(variable, label, column)

    def pattern(self) -> Pattern:
        first = self.node()
        if not self.now.signs("-", "<-"):
            return Pattern(first)
        column = self.now.column
        backwards = self.step().value == "<-"
        variable = kind = None
        self.need_sign("[")
        if self.now.kind == "name":
            variable = self.name()
        if self.sign(":"):
            kind = self.name("an edge type").upper()
        self.need_sign("]")
        self.need_sign("-" if backwards else "->")
        second = self.node()
        edge = EdgePattern(variable, kind, column)
        return Pattern(second, edge, first, True) if backwards else Pattern(first, edge, second)

    def projection(self, is_with: bool) -> Projection:
        distinct = self.word("DISTINCT")
        items = [self.item()]
        while self.sign(","):
            items.append(self.item())
        where = self.predicate() if is_with and self.word("WHERE") else None
        order = skip = limit = None
        if self.word("ORDER"):
            self.need_word("BY")
            key = self.access()
            order = (key, self.word("DESC") or (self.word("ASC") and False))
        if self.word("SKIP"):
            skip = self.amount("SKIP")
        if self.word("LIMIT"):
            limit = self.amount("LIMIT")
        if is_with and where is None and self.word("WHERE"):
            where = self.predicate()
        return Projection(tuple(items), distinct, order, skip, limit, where)

    def amount(self, of: str) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int) or self.now.value >= 2**53:
            self.fail(f"a non-negative integer after {of}")
        return self.step().value

    def item(self) -> Item:
        column = self.now.column
        if self.sign("*"):
            return Item("all", column=column)
        if self.word("COUNT"):
            self.need_sign("(")
            of = None
            if not self.sign("*") and not self.now.signs(")"):
                of = Access(self.name("a variable or *"), None, column)
            self.need_sign(")")
            made = Item("count", of, column=column)
        else:
            made = Item("access", self.access(), column=column)
        return Item(made.kind, made.access, self.name("an alias"), column) if self.word("AS") else made

    def access(self) -> Access:
        column = self.now.column
        variable = self.name("a variable")
        return Access(variable, self.name("a property name") if self.sign(".") else None, column)

    # predicates

    def predicate(self):
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Junction("OR", tuple(parts))

    def conjunction(self):
        parts = [self.atom()]
        while self.word("AND"):
            parts.append(self.atom())
        return parts[0] if len(parts) == 1 else Junction("AND", tuple(parts))

    def atom(self):
        if self.sign("("):
            inside = self.predicate()
            self.need_sign(")")
            return inside
        access = self.access()
        if self.word("IS"):
            negated = self.word("NOT")
            self.need_word("NULL")
            return Test(access, "IS NOT NULL" if negated else "IS NULL")
        if self.word("IN"):
            self.need_sign("[")
            values = []
            while not self.now.signs("]"):
                if values:
                    self.need_sign(",")
                values.append(self.literal(null=False))
            self.step()
            return Test(access, "IN", tuple(values))
        for first, op in (("CONTAINS", "CONTAINS"), ("STARTS", "STARTS WITH"), ("ENDS", "ENDS WITH")):
            if self.word(first):
                if first != "CONTAINS":
                    self.need_word("WITH")
                if self.now.kind != "string":
                    self.fail(f"a string after {op}")
                return Test(access, op, self.step().value)
        if self.sign("="):
            return Test(access, "=", self.literal(null=True))
        self.fail("=, IN, CONTAINS, STARTS WITH, ENDS WITH or IS [NOT] NULL")

    def literal(self, null: bool):
        minus = self.sign("-")
        token = self.now
        if token.kind == "number":
            self.step()
            return -token.value if minus else token.value
        if not minus:
            if token.kind == "string":
                return self.step().value
            for word, value in (("TRUE", True), ("FALSE", False)):
                if self.word(word):
                    return value
            if null and self.word("NULL"):
                return None
        self.fail("a literal")


def parse(text: str) -> Query:
    """The query's syntax tree; CypherError says what is wrong and where."""
    reject_unsupported(text)
    return _Parser(tokenize(text)).query()
