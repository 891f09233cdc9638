"""Project trees: manifest, discovery of files and bundles with content hashes, and their parse into records."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.parsers.records import COLUMNS, DDL
from tessera.staging import stage

# Kind of a file by its place below a package's main/default, as a pattern over that part of the path.
_FILE_KINDS = (
    ("apex_class", r"^classes/(?:.*/)?[^/]+\.cls$"),
    ("apex_trigger", r"^triggers/(?:.*/)?[^/]+\.trigger$"),
    ("object", r"^objects/[^/]+/[^/]+\.object-meta\.xml$"),
    ("field", r"^objects/[^/]+/fields/[^/]+\.field-meta\.xml$"),
    ("validation_rule", r"^objects/[^/]+/validationRules/[^/]+\.validationRule-meta\.xml$"),
    ("record_type", r"^objects/[^/]+/recordTypes/[^/]+\.recordType-meta\.xml$"),
    ("labels", r"^labels/[^/]+\.labels-meta\.xml$"),
    ("permission_set", r"^permissionsets/[^/]+\.permissionset-meta\.xml$"),
    ("permission_set_group", r"^permissionsetgroups/[^/]+\.permissionsetgroup-meta\.xml$"),
    ("profile", r"^profiles/[^/]+\.profile-meta\.xml$"),
    ("flexipage", r"^flexipages/[^/]+\.flexipage-meta\.xml$"),
    ("layout", r"^layouts/[^/]+\.layout-meta\.xml$"),
    ("flow", r"^flows/[^/]+\.flow-meta\.xml$"),
    ("static_resource", r"^staticresources/[^/]+\.resource-meta\.xml$"),
    ("email_template", r"^email/[^/]+/[^/]+\.email(?:-meta\.xml)?$"),
    ("vf_page", r"^pages/[^/]+\.page$"),
    ("vf_component", r"^components/[^/]+\.component$"),
    ("lwc", r"^lwc/[^/]+/[^/]+$"),
    ("aura", r"^aura/[^/]+/[^/]+$"),
)
#: Kinds of which all files of one name or folder are one logical file.
_BUNDLES = ("lwc", "aura", "email_template")


class ManifestError(ValueError):
    pass


def read_manifest(spark: SparkSession, root: str) -> dict:
    """packages (paths), namespace and api_version of a project's manifest."""
    try:
        raw = spark.read.text(f"{root.rstrip('/')}/sfdx-project.json", wholetext=True).first()["value"]
    except Exception as e:
        raise ManifestError(f"no readable manifest in {root}") from e
    import json

    try:
        data = json.loads(raw)
    except ValueError as e:
        raise ManifestError(f"manifest of {root} isn't JSON") from e
    packages = [p["path"] for p in data.get("packageDirectories") or [] if p.get("path")]
    if not packages:
        raise ManifestError("packageDirectories must name a package")
    return {"packages": packages, "namespace": data.get("namespace") or None, "api_version": data.get("sourceApiVersion")}


def _kind(inside: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_FILE_KINDS):
        out = F.when(inside.rlike(pattern), kind).otherwise(out)
    return out


#: A file that changed this short a time before it was looked at may change again within the clock's resolution.
RACY_SECONDS = 1
#: Files of a task that reads, and bytes of a batch that it hands on; a longer file is a batch of its own.
FILES_A_TASK, BATCH_BYTES = 500, 8 << 20
#: Files of a task that parses, once there are as many tasks as the cluster has cores.
FILES_A_PARSE = 8_000


def open_root(root: str) -> tuple:
    """(Arrow file system, path in it) of a root, where a task runs; Hadoop's names for S3 count as S3."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]*:/", root):
        return fs.LocalFileSystem(), root.rstrip("/")
    root = re.sub(r"^file:/(?!/)", "file:///", root)
    store, top = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root))
    return store, top.rstrip("/")


_LISTING_DDL = "below string, folder boolean, at long, length long"
_LISTING = pa.schema([("below", pa.string()), ("folder", pa.bool_()), ("at", pa.int64()), ("length", pa.int64())])


def _lister(root: str, whole: bool):
    """A task's listing of the folders it is given, with all below them if ``whole``; files pass as they are. Folders
    that aren't there, and those whose name begins with a dot, are passed over."""

    def run(batches):
        from pyarrow import fs

        files, top = open_root(root)
        for b in batches:
            is_folder = b.column("folder")
            yield b.filter(pc.invert(is_folder))
            for below in b.filter(is_folder).column("below").to_pylist():
                if below.rsplit("/", 1)[-1].startswith("."):
                    continue
                met = files.get_file_info(fs.FileSelector(f"{top}/{below}", allow_not_found=True, recursive=whole))
                met = [i for i in met if i.type == fs.FileType.File or not whole]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i.path[len(top) + 1 :] for i in met], pa.string()), pa.array([i.type == fs.FileType.Directory for i in met], pa.bool_()),
                    pa.array([(i.mtime_ns or 0) // 1_000_000 for i in met], pa.int64()), pa.array([i.size if i.is_file else 0 for i in met], pa.int64()),
                ], schema=_LISTING)

    return run


def _listed(spark: SparkSession, root: str, packages: list[str]) -> DataFrame:
    """below (path under ``root``), at (ms) and length of the packages' files, listed by tasks: the first two levels one
    folder at a time, what is below them by a task for each folder. No file is read."""
    folders = sorted({f"{p.strip('/')}/main/default" for p in packages})
    start = spark.createDataFrame([(f, True, 0, 0) for f in folders if not any(f.startswith(f"{g}/") for g in folders)], _LISTING_DDL)
    many = spark.sparkContext.defaultParallelism
    for whole in (False, False, True):
        start = start.repartition(many, "below").mapInArrow(_lister(root, whole), _LISTING_DDL)
    return start.where("not folder").drop("folder")


def _with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` with the bytes of the file ``below`` as ``content``, read where the rows are."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, content binary"

    def run(batches):
        store, top = open_root(root)
        for b in batches:
            at, held, size = 0, [], 0
            for i, below in enumerate(b.column("below").to_pylist(), 1):
                with store.open_input_stream(f"{top}/{below}", compression=None) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i == b.num_rows:
                    cut = b.slice(at, i - at)
                    yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(held, pa.binary())], names=[*cut.schema.names, "content"])
                    at, held, size = i, [], 0

    return files.mapInArrow(run, schema)


def _logical(files: DataFrame, packages: list[str]) -> DataFrame:
    """``files`` (below, ...; narrow rows) that belong to a package, with kind, file_path, parent, and place and name within it."""
    inside = None
    for p in packages:
        prefix = f"{p.strip('/')}/main/default/"
        here = F.when(F.col("below").startswith(prefix), F.expr(f"substr(below, {len(prefix) + 1})"))
        inside = here if inside is None else F.coalesce(inside, here)
    # stored, so that the many patterns of a kind meet a column and not the expressions behind it
    files = stage(files.withColumn("_in", inside).where(F.col("_in").isNotNull() & ~F.col("_in").rlike(r"(^|/)\.")))
    files = files.withColumn("kind", _kind(F.col("_in"))).where("kind is not null")
    folder = F.regexp_replace("below", r"/[^/]+$", "")
    mail = F.regexp_replace("below", r"\.email(-meta\.xml)?$", ".email-meta.xml")
    of = F.when(F.col("kind").isin("lwc", "aura"), folder).when(F.col("kind") == "email_template", mail).otherwise(F.col("below"))
    parent = F.when(F.col("_in").startswith("objects/"), F.regexp_extract("_in", r"^objects/([^/]+)/", 1)).when(F.col("kind") == "email_template", F.regexp_extract("_in", r"^email/([^/]+)/", 1))
    told = {"file_path": of, "parent": parent, "place": F.when(F.col("below") == of, 0).otherwise(1), "name": F.regexp_extract("below", r"([^/]+)$", 1)}
    return files.withColumns(told)


def _racy(at: Column) -> Column:
    """Whether a file of that time (ms) may still change within the clock's resolution."""
    return at > F.unix_millis(F.current_timestamp()) - 1000 * RACY_SECONDS


def settled(spark: SparkSession, root: str) -> bool:
    """Whether no file of the project changed just now; reads the listing alone."""
    root = root.rstrip("/")
    packages = read_manifest(spark, root)["packages"]
    return _logical(_listed(spark, root, packages), packages).where(_racy(F.col("at"))).isEmpty()


def discover(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """kind, file_path (below ``root``), parent, content_hash (SHA-1), parts (name, text; the main one first) and stamp
    of every logical file of the project's packages. Absent packages, dot files and what lies in dot folders are passed
    over; empty files count, and so do names that begin with ``_``. Tasks list and read the tree, by Arrow's file systems.

    A stamp tells the times and lengths of a file's parts; it is null if one changed just before it was looked at.
    ``known`` (file_path, content_hash, stamp): files whose stamp is known are not read; they come with the known hash
    and without parts. The listing itself reads no bytes.
    """
    root = root.rstrip("/")
    packages = read_manifest(spark, root)["packages"]
    whole = ["kind", "file_path", "parent"]
    part = F.struct("place", "name", "at", "length", "below")
    listed = _logical(_listed(spark, root, packages), packages).groupBy(*whole).agg(F.array_sort(F.collect_list(part)).alias("p"))
    racy = _racy(F.array_max(F.transform("p", lambda x: x["at"])))
    stamp = F.when(~racy, F.sha1(F.to_json(F.transform("p", lambda x: F.struct(x["name"], x["at"], x["length"])))))
    listed = stage(listed.withColumn("stamp", stamp))
    told = spark.createDataFrame([], "file_path string, content_hash string, stamp string") if known is None else known.select("file_path", "content_hash", "stamp")
    same = listed.join(told.where("stamp is not null"), ["file_path", "stamp"])
    texts = "array<struct<name:string,text:string>>"
    same = stage(same.select(*whole, "content_hash", F.lit(None).cast(texts).alias("parts"), "stamp"))
    new = stage(listed.join(same.select("file_path"), "file_path", "left_anti").select(*whole, "stamp", F.explode("p").alias("p")).select(*whole, "stamp", "p.place", "p.name", "p.below"))
    tasks = -(-new.count() // FILES_A_TASK) or 1
    body = F.struct("place", "name", F.decode("content", "UTF-8").alias("text"), F.sha1("content").alias("sha"))
    read = _with_content(new.repartition(tasks, "below"), root).groupBy(*whole, "stamp").agg(F.array_sort(F.collect_list(body)).alias("p"))
    joined = F.concat_ws("\n", F.transform("p", lambda x: F.concat(x["name"], F.lit(":"), x["sha"])))
    hashed = F.when(F.col("kind").isin(*_BUNDLES), F.sha1(joined)).otherwise(F.col("p")[0]["sha"])
    return read.select(*whole, hashed.alias("content_hash"), F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"))).alias("parts"), "stamp").unionByName(same)


def parse_files(files: DataFrame, count: int | None = None) -> DataFrame:
    """The records (nodes, edges, references, warnings) of discovered files. They are dealt out evenly: a parser works
    long for few bytes, so the splits of the table that they come in are no guide. ``count``: of the files, if known."""
    count = files.count() if count is None else count
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-count // FILES_A_PARSE))

    def run(batches):
        from tessera.sources.parsers import parse

        for b in batches:
            rows = []
            for f in b.itertuples():
                rows += parse(f.kind, f.file_path, f.parent, [(p["name"], p["text"]) for p in f.parts]).rows
            made = pd.DataFrame(rows, columns=list(COLUMNS))
            for c in ("start_line", "end_line", "line", "arity"):
                made[c] = made[c].astype("Int32")
            yield made

    return files.select("kind", "file_path", "parent", "parts").repartition(tasks, "file_path").mapInPandas(run, DDL)
