"""Indexing of project trees, whole or incremental, and the stream that follows a tree.

Beside the graph the index keeps the records of every file, the symbols that each reference looks up, by symbol, and
the record that each edge came from. An incremental run parses files whose content hash changed, merges the nodes that
these files tell of, resolves the references that a changed node can affect, and replaces their edges; so it ends in the
same graph as a full run, and edges from unchanged files into changed ones survive.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.graph import PropertyGraph, now_ms, number_rows
from tessera.operators import counts, incremental, resolve
from tessera.operators.schema import reverse_index
from tessera.sources import project as tree
from tessera.sources.parsers.records import DDL
from tessera.staging import stage
from tessera.streaming import commits

_RECORDS = "project_id long, rec_id string, " + DDL
_LOOKUPS = "project_id long, bucket int, key string, rec_id string, file_path string"
_LINKS = "project_id long, edge_id long, rec_id string, file_path string"
_STAMPS = "project_id long, file_path string, stamp string"


@dataclass(frozen=True)
class Index:
    """A graph with the file ``records`` it was resolved from, the symbols their references look up (``lookups``), and
    the record of each edge (``links``); ``stamps``: times and lengths of the files as they were read; ``counts``: degrees
    and histograms, kept up with each run's changes. ``version``: that of the store it was read from."""

    graph: PropertyGraph
    records: DataFrame
    lookups: DataFrame
    links: DataFrame
    stamps: DataFrame
    counts: DataFrame
    version: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Index:
        return Index(PropertyGraph.empty(spark), *(spark.createDataFrame([], ddl) for ddl in (_RECORDS, _LOOKUPS, _LINKS, _STAMPS, counts.DDL)))

    def save(self, path: str) -> int:
        """Commits this index as the version after its own; ``CommitConflict`` if another writer did so meanwhile."""
        data = commits.new_data(path)
        self.graph.save(data)
        for name, by in (("records", ["project_id"]), ("lookups", ["project_id", "bucket"]), ("links", ["project_id"]), ("stamps", ["project_id"]), ("counts", ["project_id", "what"])):
            getattr(self, name).write.partitionBy(*by).parquet(f"{data}/{name}.parquet")
        return commits.commit(self.graph.spark, path, self.version, data)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        version, data = commits.current(spark, path)
        if not version:
            return Index.empty(spark)
        tables = (spark.read.schema(ddl).parquet(f"{data}/{name}.parquet") for name, ddl in (("records", _RECORDS), ("lookups", _LOOKUPS), ("links", _LINKS), ("stamps", _STAMPS), ("counts", counts.DDL)))
        return Index(PropertyGraph.load(spark, data), *tables, version)


def index_project(index: Index, root: str, mode: str = "incremental", at: int | None = None) -> tuple[Index, dict]:
    """The index after a run over the tree at ``root``, and the run's counts; totals are those of the whole project.
    An incremental run reads files whose times or lengths changed, parses those of them whose content did."""
    if mode not in ("incremental", "full"):
        raise ValueError("mode must be incremental or full")
    graph = index.graph
    spark, at = graph.spark, at or now_ms()
    manifest = tree.read_manifest(spark, root)
    graph, p = graph.upsert_project(root.rstrip("/"), os.path.basename(root.rstrip("/")), manifest["api_version"])
    known = graph.file_hashes.where(F.col("project_id") == p)
    if mode == "full":
        known = known.where("false")
    found = stage(tree.discover(spark, root, known.join(index.stamps.where(F.col("project_id") == p).select("file_path", "stamp"), "file_path", "left")))
    changed = resolve.changed_files(found, known)
    n_changed = changed.count()
    n_removed = resolve.removed_files(found, known).count()
    stale = not graph.projects.where((F.col("id") == p) & F.col("indexed_at").isNotNull()).count()
    touched = 0
    if n_changed or n_removed or stale or mode == "full":
        old = index.records.where(F.col("project_id") == p)
        kept_files = found.select("file_path", "content_hash").join(known.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").select("file_path")
        fresh = stage(_told(tree.parse_files(changed, n_changed), p))
        index, touched = _maintained(replace(index, graph=graph), p, old, fresh, stage(kept_files), found, at)
        graph = index.graph
    mine = index.records.where(F.col("project_id") == p)
    graph = graph.mark_indexed(p, at)
    out = {
        "project_id": p, "files": found.count(), "files_parsed": n_changed, "files_removed": n_removed, "nodes": graph.project_nodes(p).count(),
        "edges": graph.project_edges(p).count(), "files_read": found.where("parts is not null").count(), "references_resolved": touched, "new_project": bool(stale), **_warnings(mine),
    }
    return replace(index, graph=graph), out


def index_into(spark: SparkSession, store: str, root: str, mode: str = "incremental", index: Index | None = None, tries: int = 20) -> tuple[Index, dict]:
    """Indexes the tree and commits to ``store``; if another writer came first, again on top of what it wrote. Returns
    the index as stored. A run that changes nothing commits nothing. ``index``: the store's, where it is at hand."""
    index = index or Index.load(spark, store)
    for _ in range(tries):
        after, counts = index_project(index, root, mode)
        if index.version and mode != "full" and not (counts["files_parsed"] or counts["files_removed"] or counts["new_project"]):
            return index, counts
        try:
            after.save(store)
            return Index.load(spark, store), counts
        except commits.CommitConflict:
            index = Index.load(spark, store)
    raise commits.CommitConflict(f"{store} changed under {tries} runs")


def _warnings(records: DataFrame) -> dict:
    """The first 100 texts, and the number of all."""
    some = records.where("rec = 'warning'").select("text", "file_path")
    return {"warnings": [r["text"] for r in some.orderBy("file_path", "text").limit(100).collect()], "warning_count": some.count()}


def _told(records: DataFrame, p: int) -> DataFrame:
    """Parsed records with the project and an id each."""
    return records.withColumns({"project_id": F.lit(p).cast("long"), "rec_id": F.expr("uuid()")}).select(*[c.split()[0] for c in _RECORDS.split(", ")])


def _maintained(index: Index, p: int, old: DataFrame, fresh: DataFrame, kept_files: DataFrame, found: DataFrame, at: int) -> tuple[Index, int]:
    """The index after the records ``fresh`` have taken the place of those of all files but ``kept_files``, and the
    number of edge and reference records that were resolved. All of ``found`` are the project's files now."""
    graph, name = index.graph, ["label", "qualified_name"]
    kept, gone = (stage(old.join(kept_files, "file_path", how).select(*old.columns)) for how in ("left_semi", "left_anti"))
    mine = kept.unionByName(fresh)

    # nodes: those that changed files told or tell of
    names = stage(gone.unionByName(fresh).where("rec = 'node'").select(*name).distinct())
    incoming = stage(_merged_nodes(mine.join(names, name, "left_semi"), found, p))
    before = stage(graph.project_nodes(p).join(names, name, "left_semi").select(*model.NODES.fieldNames()))
    rest = graph.nodes.join(before.select("id"), "id", "left_anti").select(*model.NODES.fieldNames())
    above = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    after = replace(graph, nodes=before.join(incoming.select(*name), name, "left_semi").select(*model.NODES.fieldNames())).upsert_nodes(incoming, at, above=above)
    after = stage(after.nodes)
    graph = replace(graph, nodes=stage(rest.unionByName(after)))

    # references: those of changed files, and those that a changed node can affect
    own = lambda t: t.where(F.col("project_id") == p)
    lookups = own(index.lookups)
    hit = stage(incremental.affected(lookups, stage(incremental.changed_symbols(before, after))).join(kept.select("rec_id"), "rec_id", "left_semi"))
    again = stage(kept.join(hit, "rec_id", "left_semi").select(*kept.columns).unionByName(fresh).where("rec in ('edge', 'ref')"))
    lost = own(index.links).join(hit, "rec_id", "left_semi").unionByName(own(index.links).join(kept_files, "file_path", "left_anti").select(*index.links.columns))
    lost = stage(lost.select("edge_id").distinct())
    gone_edges = graph.edges.join(lost.withColumnRenamed("edge_id", "id"), "id", "left_semi").select("project_id", "source_id", "target_id", "edge_type")
    edges = graph.edges.join(lost.withColumnRenamed("edge_id", "id"), "id", "left_anti").select(*model.EDGES.fieldNames())
    top = graph.edges.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = stage(_numbered_edges(graph, p, again, top).join(again.select("rec_id", "file_path"), "rec_id"))
    counted = counts.merged(index.counts, stage(counts.change(before, gone_edges, after, new)))
    graph = replace(graph, edges=stage(edges.unionByName(_as_edges(new))))
    links = index.links.join(lost, "edge_id", "left_anti").select(*index.links.columns).unionByName(new.select("project_id", F.col("id").alias("edge_id"), "rec_id", "file_path"))
    looked = incremental.symbols_in(fresh).select(F.lit(p).cast("long").alias("project_id"), incremental.bucket().alias("bucket"), "key", "rec_id", "file_path")
    others = lambda t: t.where(F.col("project_id") != p)
    lookups = others(index.lookups).unionByName(lookups.join(kept_files, "file_path", "left_semi").select(*index.lookups.columns)).unionByName(looked)

    # files: their state, and which of them refer to which
    state = _file_states(found, p, at)
    moved = before.select("file_path").unionByName(after.select("file_path")).unionByName(again.select("file_path")).unionByName(gone.select("file_path"))
    moved = stage(moved.where("file_path is not null").distinct())
    back = own(graph.file_backrefs)
    for side in ("target_file", "referring_file"):
        back = back.join(moved.withColumnRenamed("file_path", side), side, "left_anti")
    back = back.unionByName(_file_pairs(graph, p, moved).withColumn("project_id", F.lit(p).cast("long")))
    graph = replace(
        graph,
        file_hashes=stage(others(graph.file_hashes).unionByName(state)),
        file_backrefs=stage(others(graph.file_backrefs).unionByName(back.select(*graph.file_backrefs.columns))),
    )
    records = others(index.records).unionByName(mine.select(*index.records.columns))
    stamps = others(index.stamps).unionByName(found.select(F.lit(p).cast("long").alias("project_id"), "file_path", "stamp"))
    return Index(graph, stage(records), stage(lookups), stage(links), stage(stamps), stage(counted), index.version), again.count()


def _numbered_edges(graph: PropertyGraph, p: int, records: DataFrame, above: int) -> DataFrame:
    """The edges that the records resolve to, with rec_id, and with ids above ``above`` in a total order."""
    new = resolve_records(graph.project_nodes(p), records).withColumn("project_id", F.lit(p).cast("long"))
    order = [F.col(c) for c in ("source_id", "target_id", "edge_type", "source_line", "properties", "rec_id")]
    return number_rows(new, order, "_nth").withColumn("id", F.col("_nth") + above)


def _as_edges(numbered: DataFrame) -> DataFrame:
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in model.EDGES])


def _file_states(found: DataFrame, p: int, at: int) -> DataFrame:
    return found.select(F.lit(p).cast("long").alias("project_id"), "file_path", "content_hash", F.lit(at).alias("indexed_at"))


def _file_pairs(graph: PropertyGraph, p: int, files: DataFrame) -> DataFrame:
    """The pairs of the reverse index with one of ``files`` in them, from the edges at these files' nodes."""
    ids = stage(graph.project_nodes(p).join(files, "file_path", "left_semi").select("id"))
    near = graph.project_edges(p)
    near = near.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(near.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*near.columns), allowMissingColumns=False)
    return reverse_index(replace(graph, edges=near), p)


def _merged_nodes(records: DataFrame, found: DataFrame, p: int) -> DataFrame:
    """One row for each node that the records tell of: a real one beats a placeholder, then the first file."""
    real = F.struct(
        F.coalesce(F.get_json_object("properties", "$.isPlaceholder") == "true", F.lit(False)).alias("placeholder"), "file_path", F.coalesce("start_line", F.lit(0)).alias("_l"),
        "name", "start_line", "end_line", "properties",
    )
    merged = records.where("rec = 'node'").groupBy("label", "qualified_name").agg(F.min(real).alias("n"))
    return merged.select(F.lit(p).cast("long").alias("project_id"), "label", "qualified_name", "n.*").join(found.select("file_path", "content_hash"), "file_path", "left")


def graph_of_files(spark: SparkSession, files: DataFrame) -> PropertyGraph:
    """The graph, as project 1, of a table of discovered files: kind, file_path, parent, content_hash and parts. It is
    what a full run makes, but there is nothing before it to compare with, and what only an ``Index`` has isn't made."""
    graph, p = PropertyGraph.empty(spark).upsert_project("files", "files")
    found = stage(files.select("file_path", "content_hash"))
    records = stage(_told(tree.parse_files(files, found.count()), p))
    graph = replace(graph, nodes=stage(graph.upsert_nodes(stage(_merged_nodes(records, found, p))).nodes))
    graph = replace(graph, edges=stage(_as_edges(_numbered_edges(graph, p, records.where("rec in ('edge', 'ref')"), 0))))
    pairs = reverse_index(graph, p).withColumn("project_id", F.lit(p).cast("long")).select(*graph.file_backrefs.columns)
    return replace(graph, file_hashes=_file_states(found, p, 0), file_backrefs=pairs)


def resolve_records(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Edges (rec_id, source_id, target_id, edge_type, confidence, properties, source_file, source_line) of all records
    whose ends exist; what isn't found is dropped."""
    named = nodes.select("id", "label", "qualified_name", "name", "properties")
    source = named.select(F.col("id").alias("source_id"), "label", "qualified_name")
    target = named.select(F.col("id").alias("target_id"), F.col("label").alias("t_label"), F.col("qualified_name").alias("t_name"))

    def edges(df: DataFrame, kind: Column | str, confidence: Column, file: Column, line: Column, props: Column) -> DataFrame:
        return df.select(F.col("ref_id").alias("rec_id"), "source_id", "target_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), confidence.cast("double").alias("confidence"), props.alias("properties"), file.alias("source_file"), line.cast("int").alias("source_line"))

    sure, none, empty = F.lit(model.RESOLVED), F.lit(None).cast("string"), F.lit("{}")
    direct = records.where("rec = 'edge'").withColumnRenamed("rec_id", "ref_id").join(source, ["label", "qualified_name"]).join(target, ["t_label", "t_name"])
    out = edges(direct, F.col("edge_type"), F.col("confidence"), none, F.col("line"), F.col("properties"))

    refs = stage(records.where("rec = 'ref'").join(source, ["label", "qualified_name"]).select("ref", "label", "text", "arity", "owner", "line", "file_path", "source_id", F.col("properties").alias("how"), F.col("rec_id").alias("ref_id")))

    def types(*labels: str) -> DataFrame:
        some = named.where(F.col("label").isin(*labels))
        both = some.select(F.lower("name").alias("key"), "id").unionByName(some.select(F.lower("qualified_name").alias("key"), "id"))
        return both.groupBy("key").agg(F.max("id").alias("target_id"))  # of equal names the highest id

    classes, interfaces = types("ApexClass"), types("ApexInterface")
    key = F.lower("text").alias("key")
    extends = refs.where("ref = 'extends'").select("source_id", "label", "ref_id", key)
    parents = resolve.first_found(extends, ["ref_id"], [extends.join(c, "key").select("ref_id", "target_id") for c in (classes, interfaces)])
    out = out.unionByName(edges(parents, "EXTENDS", sure, none, F.lit(None), empty))
    out = out.unionByName(edges(refs.where("ref = 'implements'").select("ref_id", "source_id", key).join(interfaces, "key"), "IMPLEMENTS", sure, none, F.lit(None), empty))
    made = refs.where("ref = 'new' and label = 'ApexMethod'").select("ref_id", "source_id", key, "file_path", "line").join(classes, "key")
    out = out.unionByName(edges(made, "INSTANTIATES", sure, F.col("file_path"), F.col("line"), empty))

    methods = named.where("label = 'ApexMethod'").select(
        F.col("id").alias("target_id"), F.lower(F.get_json_object("properties", "$.ownerClass")).alias("_class"), F.lower("name").alias("_method"),
        F.get_json_object("properties", "$.arity").cast("int").alias("arity"), (F.get_json_object("properties", "$.isAuraEnabled") == "true").alias("aura"),
    )
    by_name = methods.select(F.concat("_class", F.lit("."), "_method").alias("name"), "arity", "target_id", "aura", "_class", "_method")
    calls = refs.where("ref = 'call' and label = 'ApexMethod'").select("ref_id", "source_id", "arity", "owner", "file_path", "line", F.lower(F.regexp_extract("text", r"^(?:(.*)\.)?[^.]+$", 1)).alias("_to"), F.lower(F.regexp_extract("text", r"([^.]+)$", 1)).alias("_method"))
    class_names = named.where("label = 'ApexClass'").select(F.col("id").alias("target_id"), F.lower("qualified_name").alias("_class"))
    known = classes.join(class_names, "target_id").select(F.col("key").alias("_to"), "_class")
    inside = calls.where("_to in ('', 'this')").withColumn("_class", F.lower("owner"))
    outside = calls.where("_to not in ('', 'this')").join(known, "_to")
    placed = inside.unionByName(outside.select(*inside.columns)).withColumn("name", F.concat("_class", F.lit("."), "_method"))
    best = resolve.best_overload(placed, by_name).select("ref_id", "target_id", "confidence")
    out = out.unionByName(edges(placed.join(best, "ref_id"), "CALLS", F.col("confidence"), F.col("file_path"), F.col("line"), empty))

    # a class's method by its whole name, else by its own name, there first one that is open to components
    served = refs.where("ref = 'apex'").select("ref_id", "source_id", "how", "line", F.lower("text").alias("_whole"), F.lower(F.regexp_extract("text", r"([^.]+)$", 1)).alias("_method"))
    # of methods of one name the first alone can be found, so each name is one row, or one for each kind, in the join
    first = F.min("target_id").alias("target_id")
    exact = served.join(by_name.groupBy(F.col("name").alias("_whole")).agg(first), "_whole").select("ref_id", "target_id")
    short = served.join(by_name.groupBy("_method", "aura").agg(first), "_method")
    found = resolve.first_found(served, ["ref_id"], [exact, short.where("aura").select("ref_id", "target_id"), short.where("not aura").select("ref_id", "target_id")])
    out = out.unionByName(edges(found, F.get_json_object("how", "$.edge"), F.get_json_object("how", "$.confidence"), none, F.col("line"), empty))
    return out.unionByName(_soql_edges(named, refs, edges))


def _soql_edges(named: DataFrame, refs: DataFrame, edges) -> DataFrame:
    """Edges of queries' relationship paths and child queries, where every step has one meaning."""
    fields = named.where("label = 'Field'").select(
        F.regexp_extract("qualified_name", r"^([^.]+)\.", 1).alias("object"), F.get_json_object("properties", "$.referenceTo").alias("to"), incremental.up_relation().alias("up"), incremental.down_relation().alias("down")
    ).where("to is not null")
    up = fields.select("object", F.col("up").alias("relation"), F.col("to").alias("target"))
    down = fields.where("down is not null").select(F.col("to").alias("object"), F.col("down").alias("relation"), F.col("object").alias("target"))
    relations = stage(up.unionByName(down))
    asked = refs.where("ref in ('soql', 'soql_object')").select("ref_id", "ref", "source_id", "line", "how", F.split("text", r"\|")[0].alias("from"), F.split("text", r"\|").alias("_p"))
    chain = F.concat(F.slice(F.split("from", ">"), F.lit(2), F.greatest(F.size(F.split("from", ">")) - 1, F.lit(0))), F.when(F.col("ref") == "soql", F.expr("slice(split(_p[1], '[.]'), 1, size(split(_p[1], '[.]')) - 1)")).otherwise(F.array().cast("array<string>")))
    asked = stage(asked.withColumn("steps", chain))
    ends = resolve.relationship_paths(asked.select(F.col("ref_id").alias("path_id"), F.split("from", ">")[0].alias("object"), "steps"), relations).withColumnRenamed("path_id", "ref_id")
    met = asked.join(ends, "ref_id")
    leaf = F.expr("element_at(split(_p[1], '[.]'), -1)")
    field_ids = named.where("label = 'Field'").select(F.lower("qualified_name").alias("_q"), F.col("id").alias("target_id"))
    object_ids = named.where("label = 'SObject'").select(F.lower("qualified_name").alias("_q"), F.col("id").alias("target_id"))
    to_fields = met.where("ref = 'soql'").withColumn("_q", F.lower(F.concat("object", F.lit("."), leaf))).join(field_ids, "_q")
    to_objects = met.where("ref = 'soql_object'").withColumn("_q", F.lower("object")).join(object_ids, "_q")
    sure, none = F.lit(model.RESOLVED), F.lit(None).cast("string")
    return edges(to_fields, "REFERENCES_FIELD", sure, none, F.col("line"), F.col("how")).unionByName(edges(to_objects, "SOQL_QUERIES", sure, none, F.col("line"), F.lit("{}")))


#: Looks at the tree that may pass while files keep changing before they are indexed as they are.
PATIENCE = 10


def watch(spark: SparkSession, store: str, root: str, checkpoint: str, every: str = "1 second"):
    """A streaming query that keeps the index in ``store`` up to date with the tree at ``root``.

    File streams don't report files that change in place, so a rate source only keeps time. Each micro-batch lists the
    tree, without reading a file; once what changed has settled, all of it is read and indexed in one run, or after
    PATIENCE looks. A batch that runs again finds nothing to do, and other writers' versions are built upon.
    """
    waited = 0

    def step(batch: DataFrame, _: int) -> None:
        nonlocal waited
        if not tree.settled(spark, root) and waited < PATIENCE:
            waited += 1
            return
        waited = 0
        index_into(spark, store, root)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
