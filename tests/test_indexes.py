"""Stored indexes against the scans they stand for: names by trigrams, pages, natural keys, maintained counts."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.values import ignore_case
from tessera.graph import PropertyGraph
from tessera.operators import counts, search
from tessera.operators.name_index import NameIndex, required_trigrams
from tessera.operators.pages import NodeKeys, Pages

WORDS = "Account Contact Order OrderItem accountService AccountTrigger find findAll refresh Straße ſave Kelvin İstanbul ab c a.b(c) x1 x11 x015 x0035 order-7".split()


@pytest.fixture(scope="module")
def graph(spark):
    names = [*WORDS, "", None, "n" * 5_000 + "needle", *[f"{w}_{i}" for i in range(40) for w in WORDS[:8]]]
    nodes = [(i, 1, "M", name, f"q{i}", None, None, None, "{}", None, 0, 0) for i, name in enumerate(names, 1)]
    nodes += [(10_000, 2, "M", "Account", "q1", None, None, None, "{}", None, 0, 0)]
    return PropertyGraph(spark.createDataFrame(nodes, model.NODES), spark.createDataFrame([], model.EDGES), spark.createDataFrame([], model.PROJECTS))


PATTERNS = (
    "account acc ac a ^$ . .* ^account$ ^Account.*7$ order|find (order|find)item? ord(er)?item (acc|con)(ount|tact)_1 find(all)* (find)+all 0+[13]5$ x[01]+ x0{2}35 "
    r"x0{1,4}35 a\.b\(c\) [abc]+ (?:or)der (?=acc)account (?!con)account accountz?service account(?:service|trigger) [^a]ccount \bfind\b \w+_39 _3[0-9] _[1-4]2 "
    "straße strasse save kelvin istanbul İstan SAVE needle nnn{7} (ab|c)$ order-?7 (a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|q|r|s|t|u|v|w|x|y|z)(c|n|r)(c|d|o|t) "
    "(?x)acc#no find.*_1 ((x|y)1)+ re(f|g)resh zzz (zzz|find) (?i:FIND)All [a-c]ccount (acc){0}find (?:acc|ord)?find ount.?service [x&&y]1 [x[y]1]1"
).split()


def test_names_by_trigrams_equal_the_scan(spark, graph, tmp_path):
    built = NameIndex.build(graph, 1, path=str(tmp_path / "names"), rows=2_000)
    again = NameIndex.open(spark, str(tmp_path / "names"))
    assert len(PATTERNS) >= 50
    names = [r["name"] for r in graph.project_nodes(1).collect() if r["name"]]
    scans = graph.project_nodes(1).select("id", *[F.col("name").rlike(ignore_case(p)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]).collect()
    for n, pattern in enumerate(PATTERNS):
        want = sorted(r["id"] for r in scans if r[f"p{n}"])
        got = sorted(r["id"] for r in (built, again)[n % 2].matching(pattern).select("id").collect())
        assert got == want, pattern
        ways = required_trigrams(pattern)
        if ways is not None and not any(ord(c) > 127 for c in pattern):  # what Python's own engine matches holds a way
            assert all(any(all(g in name.lower() for g in w) for w in ways) for name in names if name.isascii() and re.search(pattern, name, re.I)), pattern
    with pytest.raises(ValueError):
        built.matching("(")


def test_required_trigrams():
    assert required_trigrams("abcd") == [{"abc", "bcd"}]
    assert required_trigrams("0+[13]5") == [{"015"}, {"035"}]
    assert required_trigrams("ab.cd") is None and required_trigrams("(abc)?") is None and required_trigrams("[x[y]1]abc") is None
    assert required_trigrams("(abc|abcd)e?") == [{"abc"}]


def test_rare_names_read_few_buckets(graph, tmp_path):
    index = NameIndex.build(graph, 1, path=str(tmp_path / "few"), rows=100)
    assert len(index.nodes.buckets_of(index.candidates("needle"))) == 1 and len(index.nodes.bucket) >= 3


def test_pages(spark, tmp_path):
    df = spark.range(2_000).select("id", (F.col("id") % 3).alias("k"), F.lit("same").alias("t"))
    pages = Pages.build(df, [F.col("k").desc(), F.col("id")], str(tmp_path / "p"), rows=250)
    want = sorted(range(2_000), key=lambda i: (-(i % 3), i))
    assert pages.total == 2_000 and len(pages.rows.bucket) == 8
    for offset, limit in ((0, 10), (245, 10), (1_990, 50), (1_999, 1), (2_000, 5), (0, 2_000)):
        assert [r["id"] for r in pages.page(offset, limit).collect()] == want[offset : offset + limit]
    far = pages.page(1_900, 20)
    assert [r[0].split("/")[-2] for r in pages.rows.read([7]).selectExpr("input_file_name()").distinct().collect()] == ["bucket=7"]
    assert "bucket IN (7)" in (plan := far._jdf.queryExecution().executedPlan().toString()) or "= 7" in plan
    tied = Pages.build(df.select("t"), [F.col("t")], str(tmp_path / "t"), rows=250)
    assert sum(tied.page(o, 100).count() for o in range(0, 2_000, 100)) == 2_000 and len(tied.rows.bucket) == 8
    empty = Pages.build(df.where("false"), [F.col("id")], str(tmp_path / "e"))
    assert empty.total == 0 and empty.page(0, 5).count() == 0
    with pytest.raises(ValueError):
        pages.page(-1, 5)


def test_pages_keep_the_order_of_a_query(spark, tmp_path):
    df = spark.range(3_000).select((F.col("id") * 7 % 3_000).alias("v")).orderBy("v")
    pages = Pages.build(df, [], str(tmp_path / "q"), rows=500)
    assert [r["v"] for r in pages.page(1_490, 30).collect()] == list(range(1_490, 1_520))


def test_counts_follow_changes(spark):
    kinds = "project_id long, source_id long, target_id long, edge_type string"
    edges = lambda *rows: spark.createDataFrame([*rows], kinds)
    nodes = lambda *rows: spark.createDataFrame([*rows], "project_id long, label string")
    was = counts.counts_of(nodes((1, "A"), (1, "A"), (2, "B")), edges((1, 1, 2, "E"), (1, 1, 2, "E"), (1, 3, 3, "F"), (2, 1, 9, "E")))
    gone, new = (nodes((2, "B")), edges((1, 1, 2, "E"), (1, 3, 3, "F"))), (nodes((1, "C"), (1, None)), edges((1, 2, 1, "E"), (1, 1, 2, None)))
    now = counts.merged(was, counts.change(*gone, *new))
    want = counts.counts_of(nodes((1, "A"), (1, "A"), (1, "C"), (1, None)), edges((1, 1, 2, "E"), (2, 1, 9, "E"), (1, 2, 1, "E"), (1, 1, 2, None)))
    rows = lambda df: sorted((str(r["name"]), r["what"], r["project_id"], r["id"], r["outs"], r["ins"]) for r in df.collect())
    assert rows(now) == rows(want)
    assert counts.degrees(now, 1, "F").count() == 0 and {(r["id"], r["degree"]) for r in counts.degrees(now, 1, "E").collect()} == {(1, 2), (2, 2)}
    nothing = (nodes((1, "A")).where("false"), edges((1, 1, 1, "E")).where("false"))
    assert rows(counts.merged(was, counts.change(*nothing, *nothing))) == rows(was) and counts.counts_of(*nothing).count() == 0


def test_degree_search_reads_no_edge(spark, graph, tmp_path):
    edges = spark.createDataFrame([(i, 1, 1, i + 1, "CALLS", 1.0, "{}", None, None) for i in range(1, 9)] + [(20, 1, 2, 1, "CALLS", 1.0, "{}", None, None)], model.EDGES)
    edges.write.parquet(str(tmp_path / "edges"))
    g = PropertyGraph(graph.nodes, spark.read.parquet(str(tmp_path / "edges")), graph.projects)
    kept = spark.createDataFrame(counts.counts_of(g.nodes, g.edges).select(*[c.split()[0] for c in counts.DDL.split(", ")]).collect(), counts.DDL)
    for degree in (search.Degree("CALLS", "out", 2), search.Degree("CALLS", "both", 1, 2), search.Degree("CALLS", "in", most=0), search.Degree("CALLS", "in", 0, 1)):
        found = search.search_nodes(g, 1, degree=degree, counts=kept)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in search.search_nodes(g, 1, degree=degree).collect())
        assert "edges" not in found._jdf.queryExecution().executedPlan().toString()


def test_natural_keys(spark, graph, tmp_path):
    keys = NodeKeys.build(graph, 1, str(tmp_path / "k"), rows=50)
    assert [r["name"] for r in keys.one("M", "q1").collect()] == ["Account"] and keys.one("M", "none").count() == 0 and keys.one("X", "q1").count() == 0
    assert len(keys.table.bucket) >= 5 and keys.one("M", "q1").selectExpr("input_file_name()").distinct().count() == 1
    wanted = spark.createDataFrame([("M", "q2"), ("M", "q2"), ("M", "q9"), (None, "q3"), ("M", None)], "label string, qualified_name string")
    assert sorted(r["qualified_name"] for r in keys.find(wanted).collect()) == ["q2", "q9"]
    assert keys.find(wanted.where("false")).count() == 0 and set(keys.find(wanted).columns) == set(graph.nodes.columns)
