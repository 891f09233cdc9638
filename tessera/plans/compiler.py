"""Compiles a Cypher query to one DataFrame plan, clause by clause.

A bound node or edge is a set of flat columns ``variable__field``, so Catalyst prunes what no clause reads; entities
become structs at RETURN only. A clause is a function from (DataFrame, scope) to (DataFrame, scope).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import Value
from tessera.graph import PropertyGraph
from tessera.model import EDGE_FIELDS, NODE_FIELDS
from tessera.plans import parser as ast
from tessera.plans.errors import CypherError


@dataclass(frozen=True)
class Bound:
    """A name in scope. ``prefix``: of its columns, or the column itself for a scalar."""

    kind: str  # node, edge or scalar
    prefix: str
    scalar: str = "string"  # the scalar's Value kind


@dataclass
class Result:
    """The answer as a lazy DataFrame, its column names in order, and warnings."""

    frame: DataFrame
    columns: list[str]
    warnings: list[str] = field(default_factory=list)


class _Compiler:
    def __init__(self, graph: PropertyGraph, project_id: int):
        self.graph, self.project_id = graph, project_id
        self.frame: DataFrame | None = None  # None: one row without columns
        self.scope: dict[str, Bound] = {}
        self.fresh = itertools.count()
        self.warnings: list[str] = []

    # entities

    def fields(self, kind: str) -> list[str]:
        more = self.graph.node_promoted if kind == "node" else self.graph.edge_promoted
        return [*(NODE_FIELDS if kind == "node" else EDGE_FIELDS), *("p_" + p for p in more)]

    def table(self, kind: str, prefix: str, keep: Column | None = None) -> DataFrame:
        table = self.graph.project_nodes(self.project_id) if kind == "node" else self.graph.project_edges(self.project_id)
        if keep is not None:
            table = table.where(keep)
        return table.select(*[F.col(c).alias(f"{prefix}__{c}") for c in self.fields(kind)])

    def prefix(self, name: str | None) -> str:
        return f"{name or '_'}_{next(self.fresh)}"

    def columns_of(self, bound: Bound) -> list[str]:
        return [bound.prefix] if bound.kind == "scalar" else [f"{bound.prefix}__{c}" for c in self.fields(bound.kind)]

    def id_of(self, bound: Bound) -> str:
        return bound.prefix if bound.kind == "scalar" else f"{bound.prefix}__id"

    def lookup(self, access: ast.Access, scope: dict[str, Bound]) -> Bound:
        if access.variable not in scope:
            raise CypherError(f"Unknown variable {access.variable!r}", access.column)
        return scope[access.variable]

    def value(self, access: ast.Access, scope: dict[str, Bound]) -> Value:
        bound = self.lookup(access, scope)
        if bound.kind == "scalar":
            if access.property:
                raise CypherError(f"{access.variable!r} is a value and has no properties", access.column)
            return Value(F.col(f"`{bound.prefix}`"), bound.scalar)
        if access.property is None:
            return Value(F.col(f"{bound.prefix}__id"), "number")
        name = access.property
        if "$" in name:
            raise CypherError(f"Invalid property name {name!r}", access.column)
        table = self.graph.nodes if bound.kind == "node" else self.graph.edges
        column = name if name in self.fields(bound.kind) else "p_" + name
        if column in self.fields(bound.kind):
            return Value.of(F.col(f"{bound.prefix}__{column}"), table.schema[column].dataType)
        return Value.property(F.col(f"{bound.prefix}__properties"), name)

    # predicates

    def condition(self, p, scope: dict[str, Bound]) -> Column:
        if isinstance(p, ast.Junction):
            out = self.condition(p.parts[0], scope)
            for part in p.parts[1:]:
                more = self.condition(part, scope)
                out = (out & more) if p.op == "AND" else (out | more)
            return out
        value = self.value(p.access, scope)
        if p.op == "IS NULL":
            return value.column.isNull()
        if p.op == "IS NOT NULL":
            return value.column.isNotNull()
        if p.op == "=":
            return value.equals(p.value)
        if p.op == "IN":
            out = F.lit(False)
            for x in p.value:
                out = out | value.equals(x)
            return out
        test = {"CONTAINS": Column.contains, "STARTS WITH": Column.startswith, "ENDS WITH": Column.endswith}[p.op]
        return test(value.text(), p.value)

    # clauses

    def candidate(self, pattern: ast.Pattern) -> tuple[DataFrame, dict[str, Bound]]:
        """The pattern's matches on their own, and what it binds. A node that is in scope already, or has no name, is
        not read for its label's sake if it has none: its id is on the edge."""
        binds: dict[str, Bound] = {}
        if pattern.edge is None:
            node = pattern.source
            prefix = self.prefix(node.variable)
            if node.variable:
                binds[node.variable] = Bound("node", prefix)
            if node.label is None and self.frame is None:
                self.warnings.append("The first MATCH has no label and scans every node.")
            return self.table("node", prefix, None if node.label is None else F.col("label") == node.label), binds
        edge = pattern.edge
        e = self.prefix(edge.variable)
        frame = self.table("edge", e, None if edge.type is None else F.col("edge_type") == edge.type)
        if edge.variable:
            binds[edge.variable] = Bound("edge", e)
        for node, end in ((pattern.source, "source_id"), (pattern.target, "target_id")):
            again = node.variable in binds
            if again and binds[node.variable].kind != "node":
                raise CypherError(f"{node.variable!r} is an edge, not a node", node.column)
            prefix = self.prefix(node.variable)
            known = again or node.variable is None or node.variable in self.scope
            if known and node.label is None and self.graph.trusted:
                frame = frame.withColumn(f"{prefix}__id", F.col(f"{e}__{end}"))
            else:
                side = self.table("node", prefix, None if node.label is None else F.col("label") == node.label)
                frame = frame.join(side, F.col(f"{e}__{end}") == F.col(f"{prefix}__id"))
            if again:
                frame = frame.where(F.col(f"{prefix}__id") == F.col(f"{binds[node.variable].prefix}__id"))
            elif node.variable:
                binds[node.variable] = Bound("node", prefix)
        return frame, binds

    def match(self, clause: ast.Match) -> None:
        pattern = clause.pattern
        if pattern.edge and pattern.edge.variable and pattern.edge.variable in (pattern.source.variable, pattern.target.variable):
            raise CypherError(f"{pattern.edge.variable!r} names both a node and an edge", pattern.edge.column)
        frame, binds = self.candidate(pattern)
        for name, bound in binds.items():
            if name in self.scope and self.scope[name].kind != bound.kind:
                raise CypherError(f"{name!r} is a {self.scope[name].kind} and can't be matched as a {bound.kind}", pattern.source.column)
        shared = [n for n in binds if n in self.scope]
        scope = self.scope | {n: b for n, b in binds.items() if n not in self.scope}
        where = None if clause.where is None else self.condition(clause.where, scope)
        on = None
        for n in shared:
            same = F.col(self.id_of(self.scope[n])) == F.col(self.id_of(binds[n]))
            on = same if on is None else on & same
        prior = self.frame
        if prior is None and not clause.optional:
            joined = frame
        elif clause.optional:
            prior = self.graph.spark.range(1).select() if prior is None else prior
            cond = on if where is None else where if on is None else on & where
            joined = prior.join(frame, F.lit(True) if cond is None else cond, "left")
            where = None
        else:
            joined = prior.crossJoin(frame) if on is None else prior.join(frame, on)
        if where is not None:
            joined = joined.where(where)
        self.scope = scope
        self.frame = joined.select(*[F.col(f"`{c}`") for b in scope.values() for c in self.columns_of(b)])

    def expand(self, p: ast.Projection) -> list[ast.Item]:
        out = []
        for item in p.items:
            if item.kind == "all":
                if not self.scope:
                    raise CypherError("* has no variables to stand for", item.column)
                out += [ast.Item("access", ast.Access(n, None, item.column), None, item.column) for n in self.scope]
            else:
                out.append(item)
        names = [i.name for i in out]
        twice = next((n for n in names if names.count(n) > 1), None)
        if twice:
            raise CypherError(f"Duplicate column {twice!r}", out[names.index(twice)].column)
        return out

    def project(self, p: ast.Projection, is_with: bool) -> list[tuple[str, Bound]]:
        """Replaces frame and scope by the projected ones; (name, binding) of the items in order."""
        items = self.expand(p)
        counting = any(i.kind == "count" for i in items)
        keys: list[str] = []  # columns that identify a row
        rest: list[Column] = []  # columns that depend on them
        counts: list[Column] = []
        binds: list[tuple[str, Bound]] = []
        made: list[Column] = []
        for item in items:
            if is_with and item.alias is None and not (item.kind == "access" and item.access.property is None):
                raise CypherError("An expression in WITH needs an alias", item.column)
            prefix = self.prefix(item.name.replace(".", "_").replace("(", "_").replace(")", "_").replace("*", "_"))
            if item.kind == "count":
                what = F.lit(1) if item.access is None else F.col(f"`{self.id_of(self.lookup(item.access, self.scope))}`")
                counts.append(F.count(what).alias(prefix))
                binds.append((item.name, Bound("scalar", prefix, "number")))
                continue
            bound = self.lookup(item.access, self.scope)
            if item.access.property is None and bound.kind != "scalar":
                made += [F.col(f"{bound.prefix}__{c}").alias(f"{prefix}__{c}") for c in self.fields(bound.kind)]
                keys.append(f"{prefix}__id")
                rest += [F.first(f"{prefix}__{c}").alias(f"{prefix}__{c}") for c in self.fields(bound.kind) if c != "id"]
                binds.append((item.name, Bound(bound.kind, prefix)))
            else:
                value = self.value(item.access, self.scope)
                made.append(value.shown().alias(prefix))
                keys.append(prefix)
                binds.append((item.name, Bound("scalar", prefix, "string" if value.kind == "variant" else "number" if value.kind == "bool" else value.kind)))
        before = self.scope
        source = self.frame
        hidden: list[str] = []
        order: list[Column] = []
        scope = dict(binds)
        if p.order:
            key, down = p.order
            if key.property is None and key.variable in scope or is_with:
                order = self.value(key, scope).order_keys()
            elif key.variable in scope and scope[key.variable].kind != "scalar":
                order = self.value(key, scope).order_keys()
            else:
                same = next((b for i, (_, b) in zip(items, binds, strict=True) if i.kind == "access" and i.access.name == key.name), None)
                if same is not None:
                    order = Value(F.col(same.prefix), same.scalar).order_keys() if same.kind == "scalar" else [F.col(f"{same.prefix}__id")]
                elif p.distinct or counting:
                    raise CypherError("ORDER BY after DISTINCT or count() must name a projected column", key.column)
                else:
                    for i, c in enumerate(self.value(key, before).order_keys()):
                        hidden.append(f"_sort_{i}")
                        made.append(c.alias(hidden[-1]))
                    order = [F.col(c) for c in hidden]
        if counting:
            plain = source.select(*made, *self._counted(items, source)) if made or counts else source
            out = plain.groupBy(*keys).agg(*rest, *self._count_columns(items, binds))
        else:
            out = source.select(*made)
            if p.distinct:
                out = out.dropDuplicates(keys)
        self.scope, self.frame = scope, out
        if p.where is not None:
            self.frame = self.frame.where(self.condition(p.where, scope))
        if order:
            self.frame = self.frame.orderBy(*[c.desc_nulls_last() if p.order[1] else c.asc_nulls_first() for c in order])
        if p.skip:
            self.frame = self.frame.offset(p.skip)
        if p.limit is not None:
            self.frame = self.frame.limit(p.limit)
        if hidden:
            self.frame = self.frame.drop(*hidden)
        return binds

    def _counted(self, items: list[ast.Item], source: DataFrame) -> list[Column]:
        out = []
        for n, item in enumerate(items):
            if item.kind == "count" and item.access is not None:
                out.append(F.col(f"`{self.id_of(self.lookup(item.access, self.scope))}`").alias(f"_counted_{n}"))
        return out

    def _count_columns(self, items: list[ast.Item], binds: list[tuple[str, Bound]]) -> list[Column]:
        out = []
        for n, (item, (_, bound)) in enumerate(zip(items, binds, strict=True)):
            if item.kind == "count":
                out.append((F.count(F.lit(1)) if item.access is None else F.count(f"_counted_{n}")).alias(bound.prefix))
        return out

    def returned(self, binds: list[tuple[str, Bound]]) -> DataFrame:
        out = []
        for name, bound in binds:
            if bound.kind == "scalar":
                out.append(F.col(f"`{bound.prefix}`").alias(name))
            else:
                whole = F.struct(*[F.col(f"{bound.prefix}__{c}").alias(c) for c in self.fields(bound.kind)])
                out.append(F.when(F.col(f"{bound.prefix}__id").isNotNull(), whole).alias(name))
        return self.frame.select(*out)


def compile_query(graph: PropertyGraph, project_id: int, text: str) -> Result:
    """The query's answer over one project, as a plan that nothing has run yet."""
    query = ast.parse(text)
    c = _Compiler(graph, project_id)
    for clause in query.clauses:
        if isinstance(clause, ast.Match):
            c.match(clause)
        else:
            c.project(clause.projection, is_with=True)
    binds = c.project(query.result, is_with=False)
    return Result(c.returned(binds), [n for n, _ in binds], c.warnings)
