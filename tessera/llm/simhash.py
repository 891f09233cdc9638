"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints link at ``MOST_BITS`` = 3 or fewer differing bits. Cut into two segments of 32 bits, one of them
differs by at most one bit. Each distinct fingerprint is indexed under every variant of each segment that leaves one
bit open (2 * 32 keys); fingerprints that meet under a key are verified by their whole distance. Copies have one
fingerprint and so enter the index once. Of the fingerprints under a key only a spanning forest of their links is
emitted, never all pairs; components of those forests are the components of all links.

Defined results: a null or blank text has fingerprint zero, linked like any other; a null doc_id is kept and never the
name of a component unless all its members' ids are null; repeated rows share a fingerprint; an empty table gives an
empty result; other columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stage, slices, stage
from tessera.llm.components import components

SEED, SHINGLE, MOST_BITS, SEGMENT = 42, 3, 3, 32
#: Fingerprints under one key beyond which the other segment's bytes divide them further.
DIVIDE_OVER = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    w = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    grams = list(map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))) if len(w) >= SHINGLE else [b" ".join(w)] if w else []
    if not grams:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    over = (seen @ _BITS * 2 > len(grams)).astype(np.uint8)
    return int.from_bytes(np.packbits(over, axis=1, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in slices(batches):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text, which names a row among those of one id) and fp (signed long) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return given.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _forest(fps: np.ndarray, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph in which ``near(x, others)`` links: linked ones leave the rest at once."""
    edges, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = near(x, rest)
            if hit.any():
                found = rest[hit]
                edges.append((np.full(len(found), x), found))
                todo.extend(found)
                rest = rest[~hit]
    return edges


def _linked(key: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forest of the links that belong under ``key``: each link has one key, the first that both ends share."""
    at, bit = divmod(key >> SEGMENT, SEGMENT)
    shift, one = np.uint64(at * SEGMENT), np.uint64(1 << bit)
    low = np.uint64(0xFFFFFFFF)

    def near(x, others):
        diff = others ^ np.uint64(x)
        own = (diff >> shift) & low
        ok = (np.bitwise_count(diff) <= MOST_BITS) & ((own == one) | (own == 0 if bit == 0 else False))
        return ok & (np.bitwise_count(diff & low) > 1) if at else ok

    if len(fps) <= DIVIDE_OVER:
        return _forest(fps, near)
    edges = []  # 3 bits cannot change all four bytes of the other segment
    for byte in range(4):
        value = (fps >> np.uint64((1 - at) * SEGMENT + 8 * byte)) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(value[order])) + 1):
            edges += _forest(group, near)
    return edges


def _links(batches):
    """(key, fp) sorted by key and fp -> edges (a, b) between fingerprints."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(keys, fps):
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(keys)]
        out = []
        for i in np.flatnonzero(last - first > 1):
            out += _linked(int(keys[first[i]]), fps[first[i] : last[i]])
        if out:
            a, b = (np.concatenate([e[k] for e in out]).astype(np.uint64).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for b in batches:
        keys = np.concatenate([held_k, b.column("key").to_numpy()])
        fps = np.concatenate([held_f, b.column("fp").to_numpy().view(np.uint64)])
        if len(keys):
            open_run = np.searchsorted(keys, keys[-1], side="left")  # its rest may be in the next batch
            held_k, held_f = keys[open_run:], fps[open_run:]
            yield from done(keys[:open_run], fps[:open_run])
    yield from done(held_k, held_f)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints that are linked, from distinct fingerprints ``fp``."""
    half = F.expr(f"if(v < {SEGMENT}, fp & 4294967295L, shiftrightunsigned(fp, {SEGMENT}))")
    open_bit = F.expr(f"~shiftleft(1L, v % {SEGMENT})")
    keys = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("v")).select(
        F.shiftleft(F.col("v").cast("long"), SEGMENT).bitwiseOR(half.bitwiseAND(open_bit)).alias("key"), "fp"
    )
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, fp and component_id (smallest doc_id reachable over links) of every row."""
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(stage(links(distinct)))
    member = linked.select(F.col("a").alias("fp"), "root").unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    member = stage(member.join(distinct, "fp"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "th", "fp", "component_id")


def report(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    found = near_duplicates(docs, **cols)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id; columns as they were."""
    found = stage(near_duplicates(docs, id_col=id_col, text_col=text_col))
    low = F.lit(-(2**63))
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("th").alias("_th"))
    best = best.select(F.coalesce("component_id", low).alias("_id"), "_th")
    repeated = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), low).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    kept = keyed.join(best, ["_id", "_th"], "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["_id", "_th"])
    return kept.select("_row.*")
