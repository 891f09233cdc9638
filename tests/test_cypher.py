"""The query language on a graph of three nodes, a foreign node and three edges."""

import pytest

from tessera import model
from tessera.graph import PropertyGraph
from tessera.plans.compiler import compile_query
from tessera.plans.errors import CypherError
from tessera.plans.lexer import tokenize
from tessera.plans.parser import parse


@pytest.fixture(scope="module")
def graph(spark):
    def node(i, project, name, props="{}"):
        return (i, project, "Thing", name, name, f"{name}.x", 1, 9, props, None, 0, 0)

    nodes = [node(1, 1, "A", '{"n": 5, "t": "5", "on": true, "o": {"b": 1, "a": 2}, "z": null}'), node(2, 1, "B"), node(3, 1, "C%"), node(4, 2, "Foreign")]
    edges = [(i, 1, a, b, "NEXT", 1.0, f'{{"w": {i}}}', None, None) for i, (a, b) in enumerate([(1, 2), (2, 3), (1, 4)], 1)]
    return PropertyGraph(
        spark.createDataFrame(nodes, model.NODES), spark.createDataFrame(edges, model.EDGES), spark.createDataFrame([(1, "/", "p", None, None)], model.PROJECTS)
    )


def rows(graph, text):
    return sorted((tuple(r) for r in compile_query(graph, 1, text).frame.collect()), key=str)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("MATCH (a)-[:NEXT]->(b) RETURN a.name, b.name", [("A", "B"), ("B", "C%")]),  # the foreign end is out of reach
        ("MATCH (a:Thing) OPTIONAL MATCH (a)-[:NEXT]->(b) RETURN a.name, b.name", [("A", "B"), ("B", "C%"), ("C%", None)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[:NEXT]->(b) WHERE b.name = 'C%' RETURN a.name, b.name", [("A", None), ("B", "C%"), ("C%", None)]),
        ("OPTIONAL MATCH (a:Nope) RETURN a.name", [(None,)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[:NEXT]->(b) WITH a, count(b) AS k WHERE k = 0 RETURN a.name, k", [("C%", 0)]),
        ("MATCH (a) WITH a ORDER BY a.name LIMIT 1 MATCH (a)-[:NEXT]->(b) RETURN b.name", [("B",)]),
        ("MATCH (a)-[:NEXT]->(b) MATCH (b)-[:NEXT]->(c) RETURN a.name, c.name", [("A", "C%")]),
        ("MATCH (a)-[r:NEXT]->(a) RETURN r.id", []),
        ("MATCH (a)<-[r]-(b) RETURN a.name, r.w", [("B", "1"), ("C%", "2")]),
        ("MATCH (a) WHERE a.name CONTAINS '%' RETURN a.name", [("C%",)]),
        ("MATCH (a) WHERE a.n = 5 RETURN a.name", [("A",)]),
        ("MATCH (a) WHERE a.n = '5' OR a.t = 5 RETURN a.name", []),
        ("MATCH (a) WHERE a.on = 1 AND a.on = true RETURN a.on", [("1",)]),
        ("MATCH (a) WHERE a.z = null OR a.z IN [] RETURN a.name", []),
        ("MATCH (a) WHERE a.z IS NULL AND a.o IS NOT NULL RETURN a.o", [('{"a":2,"b":1}',)]),
        ("MATCH (a) WHERE a.name IN ['A', 'B', 7] RETURN count(*) AS c", [(2,)]),
        ("MATCH (a) RETURN DISTINCT a.label AS l", [("Thing",)]),
        ("MATCH (a) WITH DISTINCT a.label AS l RETURN count(*)", [(1,)]),
        ("MATCH (a) WITH a AS x WITH * RETURN x.name AS n ORDER BY n DESC SKIP 1 LIMIT 1", [("B",)]),
        ("MATCH (a) RETURN a.name ORDER BY a.id SKIP 2", [("C%",)]),
        ("MATCH (a) WHERE (a.name STARTS WITH 'A' OR a.name ENDS WITH '%') AND a.end_line = 9 RETURN a.name", [("A",), ("C%",)]),
        ("MATCH (a) WHERE a.name = 'MATCH' RETURN a.name", []),
        ("MATCH (a:Nope) RETURN count(*)", [(0,)]),
        ("MATCH (a:Nope) RETURN a.name, count(*)", []),
    ],
)
def test_results(graph, text, expected):
    assert rows(graph, text) == sorted(expected, key=str)


def test_whole_entities_and_names(graph):
    result = compile_query(graph, 1, "MATCH (a)-[r]->(b) WHERE b.name = 'B' RETURN a, r, count(*)")
    row = result.frame.collect()[0]
    assert result.columns == ["a", "r", "count(*)"] and row["a"]["qualified_name"] == "A" and row["r"]["edge_type"] == "NEXT"
    assert result.warnings == []
    assert compile_query(graph, 1, "MATCH (a) RETURN a.name").warnings


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) RETURN b",
        "MATCH (a) WITH a.name AS n RETURN n.x",
        "MATCH (a) WITH a.name RETURN 1",
        "MATCH (a) WITH a.name AS n MATCH (n) RETURN n",
        "MATCH (a)-[a]->(b) RETURN a",
        "MATCH (a) RETURN a.name AS x, a.id AS x",
        "MATCH (a) RETURN DISTINCT a.name ORDER BY a.id",
        "MATCH (a) RETURN a.name LIMIT -1",
        "MATCH (a) RETURN a.name LIMIT 1 SKIP 1",
        "MATCH (a) RETURN a.name LIMIT 1.5",
        "MATCH (a {x: 1}) RETURN a",
        "MATCH (a)-[*1..2]->(b) RETURN a",
        "MATCH (a)-[]-(b) RETURN a",
        "MATCH (a) WHERE a.n > 3 RETURN a",
        "MATCH (a) WHERE NOT a.n = 3 RETURN a",
        "MATCH (a) RETURN sum(a.n)",
        "CREATE (a) RETURN a",
        "UNWIND [1] AS x RETURN x",
        "MATCH (a) RETURN a.match",
        "MATCH (a) WHERE a.name = 'x RETURN a",
        "RETURN 1",
        "",
    ],
)
def test_rejected(graph, text):
    with pytest.raises(CypherError):
        compile_query(graph, 1, text)


def test_error_place():
    with pytest.raises(CypherError) as e:
        parse("MATCH (a) WHERE a.n ! 3 RETURN a")
    assert e.value.column == 21


def test_literals():
    assert [t.value for t in tokenize("""'a\\n"b' "c'" 12 1.5""")][:4] == ['a\n"b', "c'", 12, 1.5]
    assert parse("MATCH (a) WHERE a.n = 'CREATE' RETURN a").clauses[0].where.value == "CREATE"
