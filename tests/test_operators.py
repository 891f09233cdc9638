"""Typed operators on small graphs, and every table query against DuckDB at the smallest scale."""

import random

import duckdb
import pytest

from tessera import model, queries
from tessera.functions.values import glob_pattern
from tessera.graph import PropertyGraph, SchemaVersionError
from tessera.operators import adjacency, diff, reports, resolve, schema, search, trace
from tessera.operators.search import Degree

SMALL = "/root/testdata/sf0.001"


def make(spark, nodes, edges, projects=(1,)):
    """nodes: (id, project, label, name, props, path); edges: (id, project, source, target, type, confidence, props)."""
    n = [(i, p, label, name, name, path, 1, 2, props, None, 0, 0) for i, p, label, name, props, path in nodes]
    e = [(i, p, a, b, t, c, props, None, None) for i, p, a, b, t, c, props in edges]
    return PropertyGraph(
        spark.createDataFrame(n, model.NODES), spark.createDataFrame(e, model.EDGES), spark.createDataFrame([(p, f"/{p}", str(p), None, None) for p in projects], model.PROJECTS)
    )


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [(1, 1, "M", "a", '{"annotations": ["AuraEnabled"], "k": 1}', "x/a.cls"), (2, 1, "M", "b", '{"k": null}', "x/b.cls"), (3, 1, "M", "c", "{}", None), (4, 2, "M", "d", "{}", None)]
    edges = [(1, 1, 1, 2, "CALLS", 1.0, "{}"), (2, 1, 2, 3, "CALLS", 0.4, "{}"), (3, 1, 3, 1, "USES", 1.0, "{}"), (4, 1, 3, 3, "CALLS", 1.0, "{}"), (5, 1, 1, 4, "CALLS", 1.0, "{}")]
    return make(spark, nodes, edges, (1, 2))


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_search(chain):
    assert names(search.search_nodes(chain, 1, degree=Degree("CALLS", "both", 3))) == ["c"]  # the loop counts twice
    assert names(search.search_nodes(chain, 1, degree=Degree("USES", "both", most=0))) == ["b"]
    assert names(search.search_nodes(chain, 1, degree=Degree("USES", "both", 0, 1))) == ["a", "b", "c"]
    assert names(search.search_nodes(chain, 1, exclude_entry_points=True)) == ["b", "c"]
    assert names(search.search_nodes(chain, 1, properties={"k": 1})) == ["a"]
    assert names(search.search_nodes(chain, 1, properties={"k": "1"})) == []
    assert names(search.search_nodes(chain, 1, properties={"k": None})) == ["b"]
    assert names(search.search_nodes(chain, 1, file_glob="X/*.CLS")) == ["a", "b"]
    assert names(search.search_nodes(chain, 1, labels=[], name_pattern="[AB]")) == ["a", "b"]
    with pytest.raises(ValueError):
        search.search_nodes(chain, 1, name_pattern="(")
    assert glob_pattern("a.b*") == r"(?iu)a\.b.*"


def test_pages_are_complete(spark):
    g = make(spark, [(i, 1, "M", "target" if i > 1100 else f"n{i}", "{}", None) for i in range(1, 1106)], [])
    seen, at = [], 0
    while at is not None:
        page = search.search_page(g, 1, name_pattern="^target$", limit=2, offset=at)
        seen += [r["id"] for r in page["results"]]
        at = page["next_offset"]
    assert seen == [1101, 1102, 1103, 1104, 1105]
    with pytest.raises(ValueError):
        search.search_page(g, 1, limit=501)


def test_trace(chain):
    def both(**how):
        n, e = trace.trace(chain, 1, "a", **how)
        return {r["name"]: r["depth"] for r in n.collect()}, {r["id"]: r["depth"] for r in e.collect()}

    assert both(direction="out", depth=2, min_confidence=0.0) == ({"a": 0, "b": 1, "c": 2}, {1: 1, 5: 1, 2: 2})
    assert both(direction="out", depth=3) == ({"a": 0, "b": 1}, {1: 1, 5: 1})
    assert both(direction="in", depth=1) == ({"a": 0, "c": 1}, {3: 1})
    assert both(depth=0) == ({"a": 0}, {})
    assert both(direction="both", depth=9, min_confidence=0.0)[1].keys() == {1, 2, 3, 4, 5}
    assert trace.trace(chain, 1, "nobody")[0].count() == 0
    small, large = (trace.trace(chain, 1, "a", depth=d, min_confidence=0)[0] for d in (1, 2))
    assert set(names(small)) <= set(names(large))


def test_level_reads_the_buckets_of_its_frontier(spark, tmp_path):
    """A ring of 400 nodes with a hub that every node calls: the hub spans buckets, a look-up skips the others."""
    nodes = [(i, 1, "M", f"m{i}", "{}", None) for i in range(401)]
    edges = [(i, 1, i, (i + 1) % 400, "CALLS", 1.0, "{}") for i in range(400)] + [(1000 + i, 1, i, 400, "USES", 1.0, "{}") for i in range(400)]
    g = make(spark, nodes, edges)
    built = adjacency.Adjacency.build(g, 1, str(tmp_path / "a"), rows=100)
    halves = built.halves
    assert len(halves.bucket) >= 12 and halves.table.count() == 1600
    hub, one = (halves.buckets_of(spark.createDataFrame([(i,)], "id long")) for i in (400, 7))
    assert len(hub) >= 3 and len(one) == 1 and halves.buckets_of(spark.createDataFrame([(999,), (None,)], "id long")) == []
    read = halves.read(one)
    assert len(read.inputFiles()) == len(halves.table.inputFiles())  # the folder is the same, the plan prunes it
    files = [r[0] for r in read.selectExpr("input_file_name()").distinct().collect()]
    assert len(files) == 1 and f"bucket={one[0]}/" in files[0]
    assert "bucket" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    again = adjacency.Adjacency.open(spark, str(tmp_path / "a"))
    for how in (dict(direction="out", depth=3), dict(direction="in", depth=2), dict(direction="both", depth=2), dict(direction="in", depth=1, edge_types=["USES"])):
        answers = []
        for near in (built, again, None):
            n, e = trace.trace(g, 1, "m7", adjacency=near, **how)
            answers.append((sorted((r["id"], r["depth"]) for r in n.collect()), sorted((r["id"], r["depth"], r["edge_type"]) for r in e.collect())))
        assert answers[0] == answers[1] == answers[2]
        seen, level, crossed = {7: 0}, {7}, {}
        for d in range(1, how["depth"] + 1):
            step = [(i, a, b) for i, _, s, t, kind, _, _ in edges if kind in how.get("edge_types", ["CALLS", "USES"]) for a, b, way in ((s, t, "out"), (t, s, "in")) if how["direction"] in (way, "both") and a in level]
            for i, _, _ in step:
                crossed.setdefault(i, d)
            level = {b for _, _, b in step} - seen.keys()
            seen |= dict.fromkeys(level, d)
        assert answers[0][0] == sorted(seen.items()) and [(i, d) for i, d, _ in answers[0][1]] == sorted(crossed.items())


def test_summaries(chain):
    assert {r["id"]: (r["node_count"], r["edge_count"]) for r in schema.project_list(chain).collect()} == {1: (3, 5), 2: (1, 0)}
    assert schema.schema_summary(chain, 1)["edges"] == {"CALLS": 4, "USES": 1}
    assert [tuple(r) for r in schema.reverse_index(chain, 1).collect()] == [("x/b.cls", "x/a.cls")]
    assert {r["id"] for r in chain.invalid_edges().collect()} == {5}
    with pytest.raises(ValueError):
        schema.schema_summary(chain, 9)


def test_impact_and_access(spark):
    nodes = [
        (1, 1, "Field", "Account.X", "{}", None), (2, 1, "ApexMethod", "C.m()", "{}", "c.cls"), (3, 1, "SObject", "Account", "{}", None), (4, 1, "Flow", "F", "{}", None),
        (5, 1, "PermissionSet", "P", "{}", None), (6, 1, "Profile", "Admin", "{}", None), (7, 1, "PermissionSetGroup", "G", "{}", None), (8, 1, "EmailTemplate", "E", "{}", None),
    ]
    edges = [
        (1, 1, 2, 1, "REFERENCES_FIELD", 1.0, '{"context": "SOQL_SELECT"}'), (2, 1, 2, 1, "REFERENCES_FIELD", 1.0, '{"context": "SOQL_SELECT"}'), (3, 1, 2, 3, "SOQL_QUERIES", 1.0, "{}"),
        (4, 1, 4, 3, "FLOW_DML_ON", 1.0, "{}"), (5, 1, 5, 1, "GRANTS_FIELD_ACCESS", 1.0, '{"enabled": false}'), (6, 1, 6, 1, "GRANTS_FIELD_ACCESS", 1.0, "{}"),
        (7, 1, 7, 5, "INCLUDES_PERMSET", 1.0, "{}"), (8, 1, 8, 1, "EMAIL_REFERENCES_FIELD", 0.6, "{}"),
    ]
    g = make(spark, nodes, edges)
    found = reports.field_report(g, 1, "Account.X")
    assert (found["field"], found["parent_sobject"]) == ("Account.X", "Account") and found["coverage"]["indirect"] == ["apex_methods", "flows"]
    assert [(r["qualified_name"], r["context"], r["file_path"]) for r in found["apex_methods"]] == [("C.m()", "SOQL", "c.cls"), ("C.m()", "SOQL_SELECT", "c.cls")]
    assert [r["context"] for r in found["flows"]] == ["FLOW_DML"] and len(found["email_templates"]) == 1 and len(found["permission_sets"]) == 2
    assert set(found) >= {"lwc_bundles", "vf_pages", "vf_components", "validation_rules", "formula_fields", "aura_components", "layouts"}
    direct = reports.field_report(g, 1, "Account.X", include_indirect=False)
    assert direct["flows"] == [] and [r["context"] for r in direct["apex_methods"]] == ["SOQL_SELECT"]
    assert reports.field_report(g, 1, "X") == {"error": 'field must be in "Object.Field" form (got "X")'}
    with pytest.raises(ValueError):
        reports.impact(g, 1, "X")
    access = reports.access_report(g, 1, "field", "Account.X")
    assert [r["qualified_name"] for r in access["permission_sets"]] == ["P"] and [r["qualified_name"] for r in access["profiles"]] == ["Admin"]
    assert access["groups"] == [{"qualified_name": "G", "members": ["P"]}] and access["total_grants"] == 2


def test_diff(spark):
    nodes = [(1, 1, "F", "same", '{"a": {"x": 1, "y": 2}}', "p"), (2, 1, "F", "old", "{}", None), (11, 2, "F", "same", '{"a": {"y": 2, "x": 1}}', "q"), (12, 2, "F", "new", "{}", None), (20, 3, "F", "far", "{}", None), (21, 3, "F", "far2", "{}", None)]
    edges = [(1, 1, 1, 1, "E", 1.0, '{"v": 1}'), (2, 1, 1, 1, "E", 1.0, '{"v": 2}'), (3, 2, 11, 11, "E", 1.0, '{"v": 2}'), (4, 2, 11, 11, "E", 1.0, '{"v": 1}'), (5, 1, 20, 21, "E", 1.0, "{}")]
    g = make(spark, nodes, edges, (1, 2, 3))
    assert sorted((r["identity"], r["change"]) for r in diff.changes(g, 1, 2).collect()) == [('["F","new"]', "added"), ('["F","old"]', "removed")]
    assert diff.changes(g, 1, 1).count() == 0
    mirrored = {r["identity"]: r["change"] for r in diff.changes(g, 2, 1).collect()}
    assert mirrored == {'["F","new"]': "removed", '["F","old"]': "added"}
    low = g.edges.withColumn("confidence", g.edges["confidence"] - (g.edges["id"] == 3).cast("double") * 0.5)
    changed = diff.changes(PropertyGraph(g.nodes, low, g.projects), 1, 2)
    assert {r["change"]: r["count"] for r in diff.summary(changed).collect()} == {"added": 1, "removed": 1, "changed": 1}
    assert [r["kind"] for r in diff.page(changed, 1, 0).collect()] == ["edge"] and diff.page(changed, 5, 9).count() == 0
    (edge,) = diff.changes(PropertyGraph(g.nodes, low, g.projects), 1, 2).where("kind = 'edge'").collect()
    one = '{{"properties":"{{\\"v\\":{}}}","confidence":{}}}'
    assert edge["before"] == f"[{one.format(1, 1.0)},{one.format(2, 1.0)}]" and edge["after"] == f"[{one.format(1, 1.0)},{one.format(2, 0.5)}]"
    with pytest.raises(ValueError):
        diff.changes(g, 1, 9)


def test_diff_counts_parallel_edges(spark):
    """Multisets: the same entry once, twice and three times; and hashes that cancel under exclusive or alone."""
    nodes = [(p * 10 + i, p, "F", f"f{i}", "{}", None) for p in (1, 2) for i in range(3)]
    entries = {1: [(0, 1, "a")] * 2 + [(1, 2, "b")] + [(2, 0, "c")] * 3, 2: [(0, 1, "a")] * 2 + [(1, 2, "b")] * 3 + [(2, 0, "c")]}
    edges = [(p * 100 + i, p, p * 10 + a, p * 10 + b, "E", 1.0, f'{{"{k}":1}}') for p, rows in entries.items() for i, (a, b, k) in enumerate(rows)]
    got = diff.changes(make(spark, nodes, edges, (1, 2)), 1, 2).collect()
    assert {(r["identity"], r["change"], r["before"].count("confidence"), r["after"].count("confidence")) for r in got} == {('["F","f1","E","F","f2"]', "changed", 1, 3), ('["F","f2","E","F","f0"]', "changed", 3, 1)}


def _shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_diff_shuffles_few_of_the_equal_edges(spark, monkeypatch):
    """All edges used to be shuffled to look up names: 72,135 rows here."""
    monkeypatch.setattr(diff, "BUCKETS", 64, raising=False)
    nodes = [(p * 10**6 + i, p, "F", f"f{i}" if (p, i) != (2, 7) else "renamed", "{}", None) for p in (1, 2) for i in range(2_000)]
    edges = [(p * 10**7 + i, p, p * 10**6 + i % 2_000, p * 10**6 + i * 7 % 1_999, "E", 1.0, f'{{"v":{i if (p, i) != (2, 500) else 0}}}') for p in (1, 2) for i in range(20_000)]
    g = make(spark, nodes, edges, (1, 2))
    before = _shuffled_rows(spark)
    got = diff.changes(g, 1, 2).collect()
    assert _shuffled_rows(spark) - before < 40_000
    names = {(p, i): "renamed" if (p, i) == (2, 7) else f"f{i}" for p in (1, 2) for i in range(2_000)}
    ends = lambda p: {(names[p, i % 2_000], names[p, i * 7 % 1_999]) for i in range(20_000)}
    changed = {("edge", f'["F","{a}","E","F","{b}"]', "changed") for a, b in [(names[1, 500], names[1, 500 * 7 % 1_999])]}
    gone, come = ends(1) - ends(2), ends(2) - ends(1)
    want = changed | {("edge", f'["F","{a}","E","F","{b}"]', "removed") for a, b in gone} | {("edge", f'["F","{a}","E","F","{b}"]', "added") for a, b in come}
    assert len(gone) > 10 and {(r["kind"], r["identity"], r["change"]) for r in got} == want | {("node", '["F","f7"]', "removed"), ("node", '["F","renamed"]', "added")}


@pytest.mark.parametrize("seed", range(3))
def test_diff_equals_brute_force(spark, monkeypatch, seed):
    """Ids that run in parallel but for some; names moved, doubled, gone and new; edges into nothing and into the other snapshot."""
    monkeypatch.setattr(diff, "BUCKETS", (1 << 15, 16, 4)[seed], raising=False)
    monkeypatch.setattr(diff, "SIEVE", (1 << 18, 8, 1)[seed], raising=False)
    rnd = random.Random(seed)
    n, shift = 400, (1_000, -5_000, 0)[seed]
    nodes, edges, last = [], [], 10_000
    ids = {1: list(range(last, last + n)), 2: [last + n * 10 * (seed == 2) + shift + i for i in range(n)]}
    for p in (1, 2):
        for i, k in enumerate(ids[p]):
            name = i if p == 1 or rnd.random() > 0.03 else rnd.randrange(n + 20)
            if rnd.random() > 0.02:
                nodes.append((k, p, "F", f"f{name}", f'{{"v":{int(p == 2 and rnd.random() < 0.05)}}}', None))
    pairs = [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(3)) for _ in range(3_000)]
    for p in (1, 2):
        for i, (a, b, v) in enumerate(pairs):
            if rnd.random() > 0.01:
                end = ids[p][b] if rnd.random() > 0.01 else rnd.choice([77, ids[3 - p][b]])
                edges.append((p * 10**6 + i, p, ids[p][a], end, "E", 1.0 if p == 1 or rnd.random() > 0.01 else 0.5, f'{{"v":{v}}}'))
    want = {}
    for p in (1, 2):
        of = {k: q for k, project, _, q, *_ in nodes if project == p}
        sides = {}
        for k, project, _, q, props, _ in nodes:
            if project == p:
                sides.setdefault(("node", f'["F","{q}"]'), []).append(props)
        for _, project, a, b, _, conf, props in edges:
            if project == p and a in of and b in of:
                sides.setdefault(("edge", f'["F","{of[a]}","E","F","{of[b]}"]'), []).append((props, conf))
        for k, v in sides.items():
            want.setdefault(k, {})[p] = max(v) if k[0] == "node" else sorted(v)
    want = {(*k, "added" if 1 not in v else "removed" if 2 not in v else "changed") for k, v in want.items() if v.get(1) != v.get(2)}
    got = diff.changes(make(spark, nodes, edges, (1, 2)), 1, 2).collect()
    assert len(want) > 100 and sorted((r["kind"], r["identity"], r["change"]) for r in got) == sorted(want)


def test_writes_and_storage(spark, tmp_path):
    g = PropertyGraph.empty(spark)
    g, p = g.upsert_project("/root", "one", "60.0")
    g, again = g.upsert_project("/root", "two")
    assert p == again and g.projects.first()["name"] == "two"
    columns = "project_id long, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string, content_hash string"
    first = spark.createDataFrame([(p, "C", n, n, f"{n}.cls", 1, 2, "{}", "h") for n in "xy"], columns)
    g = g.upsert_nodes(first, at=10)
    g = g.upsert_nodes(spark.createDataFrame([(p, "C", n, n, f"{n}.cls", 1, 2, '{"v": 1}', "h2") for n in "yz"], columns), at=20)
    by_name = {r["name"]: r for r in g.nodes.collect()}
    assert {n: r["id"] for n, r in by_name.items()} == {"x": 1, "y": 2, "z": 3}
    assert (by_name["y"]["created_at"], by_name["y"]["updated_at"], by_name["y"]["properties"]) == (10, 20, '{"v": 1}')
    g = g.append_edges(spark.createDataFrame([(p, 1, 2, "E"), (p, 1, 2, "E"), (p, 2, 3, "E")], "project_id long, source_id long, target_id long, edge_type string"))
    assert g.edges.count() == 3 and g.edges.select("id").distinct().count() == 3
    g.mark_indexed(p, 7).save(str(tmp_path / "g"))
    loaded = PropertyGraph.load(spark, str(tmp_path / "g"))
    assert loaded.nodes.count() == 3 and loaded.projects.first()["indexed_at"] == 7
    left = loaded.delete_files(p, spark.createDataFrame([("y.cls",)], "file_path string"))
    assert left.nodes.count() == 2 and left.edges.count() == 0
    spark.createDataFrame([(99,)], "schema_version int").write.mode("overwrite").parquet(str(tmp_path / "g/_meta.parquet"))
    with pytest.raises(SchemaVersionError):
        PropertyGraph.load(spark, str(tmp_path / "g"))


def test_resolution(spark):
    refs = spark.createDataFrame([(1, "f", 2), (2, "f", 9), (3, "g", 1)], "ref_id long, name string, arity int")
    targets = spark.createDataFrame([("f", 2, 10), ("f", 0, 11), ("f", 3, 5), ("g", 1, 7), ("g", 1, 8)], "name string, arity int, target_id long")
    got = {r["ref_id"]: (r["target_id"], r["confidence"]) for r in resolve.best_overload(refs, targets).collect()}
    assert got == {1: (10, 1.0), 2: (11, 0.4), 3: (7, 0.4)}
    relations = spark.createDataFrame([("Contact", "Account", "Account"), ("Account", "Owner", "User"), ("Account", "Owner", "Group")], "object string, relation string, target string")
    paths = spark.createDataFrame([(1, "Contact", ["Account"]), (2, "Contact", ["Account", "Owner"]), (3, "Contact", [])], "path_id long, object string, steps array<string>")
    assert {r["path_id"]: r["object"] for r in resolve.relationship_paths(paths, relations).collect()} == {1: "Account", 3: "Contact"}
    a = spark.createDataFrame([("k1", 5)], "k string, target_id long")
    b = spark.createDataFrame([("k1", 1), ("k2", 3), ("k2", 2)], "k string, target_id long")
    assert sorted(tuple(r) for r in resolve.first_found(b.select("k").distinct(), ["k"], [a, b]).collect()) == [("k1", 5), ("k2", 2)]


def test_long_relationship_paths(spark):
    relations = spark.createDataFrame([(f"O{i}", "Up", f"O{i + 1}") for i in range(9)], "object string, relation string, target string")
    paths = spark.createDataFrame([(n, "O0", ["up"] * n) for n in (0, 5, 6, 9, 10)], "path_id long, object string, steps array<string>")
    assert {r["path_id"]: r["object"] for r in resolve.relationship_paths(paths, relations).collect()} == {0: "O0", 5: "O5", 6: "O6", 9: "O9"}


def test_best_match_over_every_part(spark, tmp_path):
    """Brute force over parts of which most have keys of 200 and more, and names with many targets."""
    refs = [(i // 3, i * 7 % 900, i % 5) for i in range(400)]
    parts = [(i, 4 * i + 1 if i % 60 == 9 and i < 840 else 3 * i) for i in range(900)] + [(969, 2)]
    spark.createDataFrame(refs, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for ref, name, arity in {(o, f"t{p % 50}", n % 4) for o, p, n in refs}:
        found = [(size % 4, p) for p, size in parts if f"t{p % 60}" == name]
        exact = [p for a, p in found if a == arity]
        target = min(exact or [p for a, p in found if a == 0] or [p for _, p in found])
        want.add((ref, name, arity, target, 1.0 if len(exact) == 1 else 0.4))
    got = [tuple(r) for r in queries.QUERIES["resolve_best_match_all"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and any(x[3] >= 200 and x[4] == 1.0 for x in want)


@pytest.mark.parametrize("name", ["cy_count_group", "cy_optional_where", "cy_with_distinct", "cy_numeric_property", "search_degree_zero", "trace_in_d2_nodes", "schema_samples", "reverse_index", "diff_changes", "diff_contents", "resolve_best_match", "ingest_refs"])
def test_table_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))
