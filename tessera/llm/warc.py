"""Legacy archives (ARC, versions 1 and 2) to WARC 1.1.

An archive is a gzip file of bounded size, written by Spark's text writer, whose line separator is the format's record
terminator; so a lost task's files never count, and any file system Spark knows will do. Archives are read whole, one a
row, and decompressed as a stream.

``read_arc`` takes an archive's version from its version block, reads each header line by that version's fields, from
the right, as URLs may hold blanks, and then as many bytes as the line declares. ``convert`` gives each record what WARC
asks for: a name-based identifier, the date in ISO form, type response for HTTP messages, resource for anything else and
warcinfo for version blocks, SHA-1 digests of block and payload. Of responses with equal payloads of ``least`` bytes or
more one stays (the greatest of ``order``, then of its place), the others become revisits of it that keep the HTTP head
alone. Which ones is settled on narrow rows; blocks are shuffled once, by their own place, so no key is hot.

Defined results: a null payload is empty; a null URL is ``urn:none`` and comes back as null; line ends in URLs are
percent-encoded; repeated rows are records of their own; an empty table gives no rows; a null id is the smallest, and
records of one id are told apart by their place. Bytes between records that are no header line, and blocks that end
before their declared length, are kept as records with ``damage`` set; they become resources. A record must fit a
task's memory. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_stage, slices, stage
from tessera.llm.joins import join_hot
from tessera.staging import _folder, shared_dir

#: Raw bytes after which an archive is closed.
ARCHIVE_BYTES = 96 * 2**20
# fixed values of the formats
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION, WARC_END = b"WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:none"
ID_HEADER = "X-Page-Id"
_DATE = re.compile(r"\d{14}")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# writing archives of any kind

_ARCHIVED = "archive string, place long, record binary"


def _write(records: DataFrame, folder: str, separator: str) -> None:
    """``records`` (see ``_ARCHIVED``): a folder for each archive, with its records in order of place."""
    text = records.select("archive", "place", F.col("record").cast("string").alias("value")).sortWithinPartitions("archive", "place").drop("place")
    text.write.partitionBy("archive").option("lineSep", separator).option("compression", "gzip").text(folder)


def _cut(kind: str, items: Iterator, begin: Callable) -> Iterator[pa.RecordBatch]:
    """Deals ``items`` to archives by size. ``begin(name, nth)`` gives an archive's first record, and the function that
    makes an item a record of it."""
    nth, size, place, held, encode = -1, ARCHIVE_BYTES, 0, 0, None
    out: tuple[list, list, list] = ([], [], [])

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["archive", "place", "record"])
        for x in out:
            x.clear()
        return made

    for item in items:
        if size >= ARCHIVE_BYTES:
            nth, size, place = nth + 1, 0, 0
            name = f"{kind}-{TaskContext.get().partitionId():06d}-{nth:04d}"
            first, encode = begin(name, nth)
            for o, x in zip(out, (name, 0, first), strict=True):
                o.append(x)
        place += 1
        record = encode(item)
        for o, x in zip(out, (name, place, record), strict=True):
            o.append(x)
        size += len(record)
        held += len(record)
        if held > 4 * 2**20:
            yield batch()
            held = 0
    if out[0]:
        yield batch()


# legacy archives


def _arc_record(version: int, url: str, date: str, kind: str, block: bytes, name: str) -> bytes:
    said = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    return " ".join(str(len(block)) if f == "Archive-length" else said[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def _version_block(version: int, date: str, name: str) -> bytes:
    return _arc_record(version, f"filedesc://{name}", date, "text/plain", f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n".encode(), name)


def _http(page: int | None, payload: bytes) -> bytes:
    own = "" if page is None else f"{ID_HEADER}: {page}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20000101000000") -> None:
    """Legacy archives of ``pages``, of versions 1 and 2 by turns; a page is an HTTP message whose head holds its id."""

    def run(batches):
        def begin(name, nth):
            version = 1 + (nth + TaskContext.get().partitionId()) % 2
            return _version_block(version, date, name), lambda item: _arc_record(version, item[0], date, "text/html", _http(*item[1:]), name)

        items = (i for b in slices(batches) for i in zip(*(b.column(c).to_pylist() for c in ("url", "id", "payload")), strict=True))
        yield from _cut("pages", items, begin)

    plain = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit(NO_URL)), "\n", "%0A")
    given = pages.select(plain.alias("url"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    _write(given.mapInArrow(run, _ARCHIVED), folder, "\n")


def _arc_header(line: bytes, version: int) -> dict[str, str] | None:
    """Fields of a header line of that version, or None; from the right, as URLs may hold blanks."""
    fields = ARC_FIELDS[version]
    cut = line.rstrip(b"\r\n").rsplit(b" ", len(fields) - 1)
    if len(cut) != len(fields):
        return None
    found = dict(zip(fields, (x.decode("utf-8", "replace") for x in cut), strict=True))
    return found if _DATE.fullmatch(found["Archive-date"]) and found["Archive-length"].isdigit() and cut[0] else None


def _arc_records(stream) -> Iterator[tuple]:
    """(place, version, url, date, content type, block, damage) of an archive's records, version block first."""
    version, place, stray = 1, 0, b""
    while True:
        line = stream.readline()
        head = _arc_header(line, version) if line.strip() else None
        if place == 0 and line.startswith(b"filedesc://"):
            # of the version block both forms may be met: the longer one is tried first
            head = _arc_header(line, 2) or _arc_header(line, 1)
        if head is None and line and (line.strip() or stray):
            stray += line
            continue
        if stray:
            yield place, version, NO_URL, "", "application/octet-stream", stray, "no header"
            place, stray = place + 1, b""
        if not line:
            return
        if head is None:
            continue
        block = stream.read(int(head["Archive-length"]))
        if place == 0 and line.startswith(b"filedesc://"):
            version = 2 if block[:1] == b"2" else 1
        yield place, version, head["URL"], head["Archive-date"], head["Content-type"], block, None if len(block) == int(head["Archive-length"]) else "cut off"
        place += 1


def _opened(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _payload(block: bytes) -> tuple[bytes, bytes, bool]:
    """(head, payload, whether it is an HTTP message)."""
    if not block.startswith(b"HTTP/"):
        return b"", block, False
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :], True) if at >= 0 else (block, b"", True)


def _head_value(head: bytes, name: str) -> int | None:
    found = re.search(rb"(?im)^%s:\s*(-?\d+)\s*$" % re.escape(name.encode()), head)
    return int(found[1]) if found else None


_READ = "archive string, place long, version int, url string, date string, content_type string, type string, record_id string, page_id long, payload_bytes long, payload_digest string, damage string, block binary"


def read_arc(spark: SparkSession, folder: str, *, blocks: bool = True) -> DataFrame:
    """A row for each record of the legacy archives below ``folder``, with what WARC says of it; without ``blocks``, no
    block. ``archive`` is the file's path: names in version blocks may be used twice."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held = [], 0
                for place, version, url, date, kind, block, damage in _arc_records(_opened(content.as_py())):
                    head, payload, http = _payload(block)
                    what = "warcinfo" if url.startswith("filedesc://") else "response" if http and not damage else "resource"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{place} {url} {date}")
                    rows.append((path, place, version, url, date, kind, what, f"<urn:uuid:{name}>", _head_value(head, ID_HEADER), len(payload), digest32(payload), damage, block if blocks else None))
                    held += len(block) if blocks else 200
                    if held > 4 * 2**20:
                        yield _batch(rows, _READ)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, _READ)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


# WARC


def _warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    said = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    return WARC_VERSION + b"\r\n" + "".join(said).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if date else "1970-01-01T00:00:00Z"


def _converted(r: dict) -> bytes:
    head, _, http = _payload(r["block"])
    revisit = r["refers_id"] is not None
    block = head if revisit else r["block"]
    kind = "application/http; msgtype=response" if http and r["type"] == "response" else "application/warc-fields" if r["type"] == "warcinfo" else r["content_type"]
    if r["type"] == "warcinfo":
        block = b"".join(b"description: " + line + b"\r\n" for line in r["block"].splitlines())
    return _warc_record(
        [
            ("WARC-Type", "revisit" if revisit else r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", _iso(r["date"])),
            ("WARC-Target-URI", None if r["type"] == "warcinfo" else r["url"]), ("WARC-Filename", r["url"].removeprefix("filedesc://") if r["type"] == "warcinfo" else None),
            ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}" if r["type"] == "response" else None), ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", r["refers_id"]), ("WARC-Refers-To-Target-URI", r["refers_url"]),
            ("WARC-Refers-To-Date", _iso(r["refers_date"]) if revisit else None), ("WARC-Truncated", "unspecified" if r["damage"] == "cut off" else None), ("Content-Type", kind),
        ],
        block,
    )


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, *, least: int = 0) -> None:
    """WARC archives of the legacy archives; equal payloads of ``least`` bytes or more are kept once."""
    facts = stage(read_arc(spark, arc_folder, blocks=False).where("type = 'response'").drop("block"))
    large = facts.where(f"payload_bytes >= {least}")
    one = F.max(F.struct("page_id", "archive", "place", "record_id", "url", "date")).alias("one")
    kept = stage(large.groupBy("payload_digest").agg(one, F.count("*").alias("n")).where("n > 1").select("payload_digest", "one"))
    refers = [F.col(f"one.{a}").alias(f"refers_{b}") for a, b in (("record_id", "id"), ("url", "url"), ("date", "date"))]
    again = join_hot(large.select("archive", "place", "record_id", "payload_digest"), kept, ["payload_digest"]).where("record_id != one.record_id").select("archive", "place", *refers)
    again = stage(again)
    records = read_arc(spark, arc_folder).join(again, ["archive", "place"], "left")

    def run(batches):
        def begin(name, nth):
            name_of = uuid.uuid5(uuid.NAMESPACE_URL, name)
            block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
            return _warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name_of}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block), _converted

        yield from _cut("warc", (r for b in slices(batches) for r in b.to_pylist()), begin)

    _write(records.mapInArrow(run, _ARCHIVED), warc_folder, WARC_END)
    drop_stage(facts, kept, again)


def _warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC version line: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError(f"a record ends early: {headers.get('warc-record-id')}")
        yield headers, block


_WARC_READ = "record_id string, type string, url string, date string, refers_to string, page_id long, payload_bytes long, payload_digest string, block binary"


def read_warc(spark: SparkSession, folder: str, *, blocks: bool = True) -> DataFrame:
    """A row for each record of the WARC archives below ``folder``. Lengths and digests of payloads are taken anew from
    whole records, a revisit's digest from its header; a digest that contradicts its header is an error."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for h, block in _warc_records(_opened(content.as_py())):
                    head, payload, _ = _payload(block)
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    revisit = h["warc-type"] == "revisit"
                    found = said if revisit else digest32(payload)
                    if said is not None and found != said:
                        raise ValueError(f"payload digest of {h['warc-record-id']} is {found}, not {said}")
                    url = h.get("warc-target-uri")
                    rows.append((h["warc-record-id"], h["warc-type"], None if url == NO_URL else url, h.get("warc-date"), h.get("warc-refers-to"), _head_value(head, ID_HEADER), None if revisit else len(payload), found, block if blocks else None))
                    held += len(block) if blocks else 200
                    if held > 4 * 2**20:
                        yield _batch(rows, _WARC_READ)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _WARC_READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInArrow(run, _WARC_READ)


def report(pages: DataFrame, *, least: int = 0, **cols: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read from WARC archives that
    were converted from legacy archives of ``pages``."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    arcs, warcs = (f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("arc", "warc"))
    write_arc(pages, arcs, **cols)
    convert(spark, arcs, warcs, least=least)
    found = stage(read_warc(spark, warcs, blocks=False).where("type in ('response', 'revisit')").drop("block", "url", "date"))
    for folder in (arcs, warcs):
        fs, where = _folder(spark, folder)
        fs.delete(where, True)
    whole = found.where("type = 'response'")
    to = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_to"), F.col("payload_bytes").alias("_bytes"))
    again = join_hot(found.where("type = 'revisit'").drop("payload_bytes"), to, ["refers_to"])
    cols_of = lambda n, to: ["page_id", n, "payload_digest", F.col("type").alias("record_type"), to]
    return whole.select(*cols_of("payload_bytes", F.lit(None).cast("long").alias("refers_to"))).unionByName(again.select(*cols_of(F.col("_bytes").alias("payload_bytes"), F.col("_to").alias("refers_to"))))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top,
    list_reduce(list_transform(range(40), lambda i: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[instr('0123456789abcdef', sha1(html)[i + 1])]), lambda x, y: x || y) AS bits
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""
