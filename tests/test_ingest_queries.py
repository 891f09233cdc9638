"""The graph indexed from files made of the tables, against the SQL of what must come out."""

import glob
import os

import duckdb
import pytest

from tessera import ingest_queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    return out


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_oracle(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted(map(str, map(tuple, df.selectExpr(*[f"`{c}`" for c in sorted(df.columns)]).collect())))
    want = sorted(map(str, con.execute(f"SELECT {columns} FROM ({q.ORACLE[name]})").fetchall()))
    assert got and got == want


def _files(spark, classes, bundles):
    cls = "public class P{0} { @AuraEnabled public static void go() { } public void stay() { } }"
    js = "import go from '@salesforce/apex/P{0}.{1}';"
    rows = [("apex_class", f"classes/P{k}.cls", None, f"h{k}", [(f"P{k}.cls", cls.replace("{0}", str(k)))]) for k in range(classes)]
    rows += [("lwc", f"lwc/c{k}", None, f"b{k}", [(f"c{k}.js", js.replace("{0}", str(k)).replace("{1}", ("go", "stay", "gone")[k % 3]))]) for k in range(bundles)]
    return spark.createDataFrame(rows, "kind string, file_path string, parent string, content_hash string, parts array<struct<name:string,text:string>>")


def _join_rows(node):
    """The most rows that a join of an executed plan made."""
    kind = node.getClass().getSimpleName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    made = node.metrics().get("numOutputRows")
    return max([made.get().value() if "Join" in kind and made.isDefined() else 0, *map(_join_rows, below)])


def test_component_calls_meet_each_method_name_once(spark):
    """Joined by name alone, 150 bundles and 400 methods of one name were 60,000 rows."""
    from tessera.sources.project import parse_files
    from tessera.staging import stage
    from tessera.streaming import ingest

    graph = ingest.graph_of_files(spark, _files(spark, 400, 150))
    records = stage(ingest._told(parse_files(_files(spark, 400, 150)), 1))
    edges = ingest.resolve_records(graph.nodes, records.where("rec in ('edge', 'ref')"))
    found = edges.where("edge_type = 'LWC_USES_APEX'")
    name = {r["id"]: r["qualified_name"] for r in graph.nodes.collect()}
    got = sorted((name[r["source_id"]], name[r["target_id"]]) for r in found.collect())
    assert got == sorted((f"c{k}", f"P{k}.{('go', 'stay')[k % 3]}()") for k in range(150) if k % 3 < 2)
    assert _join_rows(found._jdf.queryExecution().executedPlan()) <= 5_000


def test_files_of_one_split_are_parsed_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from tessera.sources.project import parse_files

    records = parse_files(_files(spark, 400, 0).coalesce(1))
    by_task = records.where("rec = 'node' and label = 'ApexClass'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 400 and len(by_task) == spark.sparkContext.defaultParallelism


def test_rows_are_numbered_in_order_across_ranges(spark):
    from pyspark.sql import functions as F

    from tessera.graph import number_rows

    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"))
    got = number_rows(rows, [F.col("k")], "nth").select("k", "nth").collect()
    assert [r["nth"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1, 20_001))
