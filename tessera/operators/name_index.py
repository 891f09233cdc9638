"""Names by their trigrams: a regular expression is tried only on names that hold the trigrams it can't match without."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rx
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import ignore_case
from tessera.graph import PropertyGraph
from tessera.operators.adjacency import RangeStore
from tessera.staging import temporary_folder

#: Alternatives of a pattern that are told apart; of more, only the trigrams that all of them need are kept.
MOST_WAYS = 30
#: Rarest trigrams of an alternative that are looked up; the rest is left to the pattern itself.
LOOKED_UP = 3

#: Sets within sets and the verbose flag, which the engine that matches reads in its own way.
_READ_DIFFERENTLY = re.compile(r"\[[^\]]*\[|&&|\(\?[a-zA-Z]*x")

# A way through a pattern: the trigrams met, and the last characters (at most two) if they are known.
_Way = tuple[frozenset, str]


def _bounded(ways: set[_Way]) -> set[_Way]:
    return ways if len(ways) <= MOST_WAYS else {(frozenset.intersection(*(g for g, _ in ways)), "")}


def _then(ways: set[_Way], char: str) -> set[_Way]:
    out = set()
    for grams, tail in ways:
        run = tail + char
        out.add((grams | {run} if len(run) == 3 else grams, run[-2:]))
    return out


def _unknown(ways: set[_Way]) -> set[_Way]:
    return {(grams, "") for grams, _ in ways}


def _plain(code: int) -> str | None:
    return chr(code).lower() if 0x20 <= code < 0x7F else None


def _repeated(ways: set[_Way], least: int, most: int, body) -> set[_Way]:
    once = ways
    for _ in range(min(max(least, 1), LOOKED_UP)):
        once = _through(once, body)
    if not least == most <= LOOKED_UP:  # what follows follows the last copy
        last = _through({(frozenset(), "")}, body)
        once = {(g | h, t) for g, _ in once for h, t in last}
    return _bounded(once if least else once | ways)


def _through(ways: set[_Way], items) -> set[_Way]:
    for kind, arg in items:
        if kind is rx.LITERAL and _plain(arg) is not None:
            ways = _then(ways, _plain(arg))
        elif kind is rx.SUBPATTERN:
            ways = _through(ways, arg[-1])
        elif kind is rx.ATOMIC_GROUP:
            ways = _through(ways, arg)
        elif kind is rx.BRANCH:
            ways = set().union(*(_through(ways, way) for way in arg[1]))
        elif kind in (rx.MAX_REPEAT, rx.MIN_REPEAT, rx.POSSESSIVE_REPEAT):
            ways = _repeated(ways, *arg)
        elif kind is rx.IN and len(arg) <= 4 and all(k is rx.LITERAL and _plain(c) is not None for k, c in arg):
            ways = set().union(*(_then(ways, _plain(c)) for _, c in arg))
        elif kind not in (rx.AT, rx.ASSERT, rx.ASSERT_NOT):  # those have no width
            ways = _unknown(ways)
        ways = _bounded(ways)
    return ways


def required_trigrams(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams (ASCII, lower case): any text that the pattern matches without regard to case holds all of one
    of them. None where there may be a match without any."""
    ignore_case(pattern)  # raises on what is no pattern
    if _READ_DIFFERENTLY.search(re.sub(r"\\.", "_", pattern)):
        return None
    parsed = _parser.parse(pattern)
    ways = {grams for grams, _ in _through({(frozenset(), "")}, parsed)}
    least = [w for w in ways if not any(other < w for other in ways)]
    return None if frozenset() in ways else sorted(least, key=sorted)


def trigrams(text: Column) -> Column:
    """Hashes of the distinct trigrams of a text, in lower case; the four letters that count as ASCII ones where case
    doesn't count are taken as those."""
    folded = F.split(F.lower(F.translate(text, "ſKıİ", "skii")), "")
    three = F.transform(F.sequence(F.lit(0), F.size(folded) - 3), lambda i: F.xxhash64(F.concat(F.get(folded, i), F.get(folded, i + 1), F.get(folded, i + 2))))
    return F.array_distinct(F.when(F.size(folded) >= 3, three).otherwise(F.array().cast("array<bigint>")))


@dataclass(frozen=True)
class NameIndex:
    """The nodes of a project by id, the postings (gram, id) of one of their columns, and how many each gram has."""

    column: str
    nodes: RangeStore
    postings: RangeStore
    counts: RangeStore

    @staticmethod
    def build(graph: PropertyGraph, project_id: int, column: str = "name", path: str | None = None, rows: int | None = None) -> NameIndex:
        """Writes the index. Null names and names below three characters have no postings: a pattern that could match
        them has no required trigram either, and scans."""
        path = path or temporary_folder(graph.spark, "names")
        nodes = RangeStore.build(graph.project_nodes(project_id), "id", "label", f"{path}/nodes", rows)
        told = nodes.table.select(F.explode(trigrams(F.col(column))).alias("gram"), "id")
        postings = RangeStore.build(told, "gram", "id", f"{path}/postings", rows)
        counts = RangeStore.build(postings.table.groupBy("gram").agg(F.count("*").alias("n")), "gram", "n", f"{path}/counts", rows)
        return NameIndex(column, nodes, postings, counts)

    @staticmethod
    def open(spark: SparkSession, path: str, column: str = "name") -> NameIndex:
        return NameIndex(column, *(RangeStore.open(spark, f"{path}/{name}", key) for name, key in (("nodes", "id"), ("postings", "gram"), ("counts", "gram"))))

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids of the nodes whose name holds what the pattern needs; None if it needs no trigram."""
        ways = required_trigrams(pattern)
        if ways is None:
            return None
        spark = self.nodes.table.sparkSession
        texts = spark.createDataFrame([(g,) for g in sorted(frozenset().union(*ways))], "g string")
        known = {r["g"]: (r["n"], r["gram"]) for r in self.counts.fetch(texts.select("g", F.xxhash64("g").alias("id"))).collect()}
        ways = [w for w in ways if w <= known.keys()]  # the others hold a trigram that no name has
        each = max(1, min(LOOKED_UP, 62 // max(1, len(ways))))
        chosen = [sorted(w, key=lambda g: known[g])[:each] for w in ways]
        bit = {g: 1 << i for i, g in enumerate(sorted({g for c in chosen for g in c}))}
        wanted = spark.createDataFrame([(known[g][1], b) for g, b in bit.items()], "id long, bit long")
        met = self.postings.fetch(wanted).groupBy("id").agg(F.bit_or("bit").alias("met"))
        holds = F.lit(False)
        for c in chosen:
            need = sum(bit[g] for g in c)
            holds = holds | (F.col("met").bitwiseAND(F.lit(need)) == need)
        return met.where(holds).select("id")

    def matching(self, pattern: str) -> DataFrame:
        """The nodes whose name the pattern matches anywhere, without regard to case."""
        some = self.candidates(pattern)
        tried = self.nodes.table.drop("bucket") if some is None else self.nodes.fetch(some)
        return tried.where(F.col(self.column).rlike(ignore_case(pattern)))
