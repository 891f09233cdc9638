"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned by
them, overfull ranges are subdivided, and ranges are dealt to shards so that the shards' sizes are near equal.

The key is (hash of the text, doc_id, row tie), so equal texts are neighbours and a large group of copies can still be
cut anywhere. There are ``oversplit`` ranges a shard; their splitters and totals, a bounded number, are all that the
driver sees. Law: ``bytes``.

Defined results: a null text has no bytes (size 16, crc32 0); a null doc_id sorts first; repeated rows are told apart
by the row tie; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

OVERHEAD = 16
KEY = ("_h", "_d", "_tie")
_LOW = -(2**63)


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit columns as byte strings that compare as the columns do, first column first."""
    wide = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(wide.astype(">u8")).view(f"S{8 * len(columns)}").reshape(-1)


def _arrow_key(batch: pa.RecordBatch) -> np.ndarray:
    return _packed([batch.column(k).to_numpy(zero_copy_only=False) for k in KEY])


def _ranged(rows: DataFrame, splitters: np.ndarray, start: np.ndarray | None = None, shard: np.ndarray | None = None) -> DataFrame:
    """``rows`` with the number of their range; with the range's shard and first slot, if given."""
    placed = shard is not None

    def assign(batches):
        for b in batches:
            if b.num_rows:
                piece = np.searchsorted(splitters, _arrow_key(b), side="right")
                more = [pa.array(piece, pa.int64())]
                if placed:
                    more += [pa.array(shard[piece], pa.int32()), pa.array(start[piece], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_piece", *["shard", "_start"][: 2 * placed]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, schema + ", _piece long" + ", shard int, _start long" * placed)


def _draw(rows: DataFrame, rate: float, seed: int) -> np.ndarray:
    """Sorted packed keys, each row drawn in proportion to its size: ``size * rate`` times on average."""
    u = (F.xxhash64(*KEY, F.lit(seed)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    times = F.floor(F.col("size") * F.lit(rate) + u).cast("int")
    got = rows.select(*KEY, times.alias("times")).where("times > 0").toArrow()
    if not got.num_rows:
        return np.empty(0, "S24")
    keys = _packed([got.column(k).to_numpy() for k in KEY])
    return np.sort(np.repeat(keys, got.column("times").to_numpy()))


def _totals(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    got = ranged.groupBy("_piece").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toArrow().to_pydict()
    return dict(zip(got["_piece"], zip(got["b"], got["n"], strict=True), strict=True))


def split_points(rows: DataFrame, total: int, n_ranges: int, per_range: int, rounds: int = 3) -> tuple[np.ndarray, dict]:
    """Splitters of ranges near ``total / n_ranges`` bytes each, and each range's bytes and rows."""
    want = max(1.0, total / n_ranges)
    drawn = _draw(rows, per_range / want, 0)
    splitters = np.unique(drawn[per_range - 1 :: per_range])
    totals: dict[int, tuple[int, int]] = {}
    for again in range(1, rounds + 1):
        ranged = _ranged(rows, splitters)
        totals = _totals(ranged)
        over = [p for p, (b, n) in totals.items() if b > 2 * want and n > 1]
        if not over or again == rounds:
            break
        finer = _draw(ranged.where(F.col("_piece").isin(over)), 2 * per_range / want, again)
        splitters = np.unique(np.concatenate([splitters, finer[per_range - 1 :: per_range]]))
    return splitters, totals


def deal(totals: dict[int, tuple[int, int]], n_shards: int, n_pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and first slot of each range: largest first, each to the shard that has least so far."""
    shard, start = np.zeros(n_pieces, np.int32), np.zeros(n_pieces, np.int64)
    heap = [(0, 0, s) for s in range(n_shards)]  # bytes, rows, shard
    for p, (size, n) in sorted(totals.items(), key=lambda x: (-x[1][0], x[0])):
        filled, rows, s = heapq.heappop(heap)
        shard[p], start[p] = s, rows
        heapq.heappush(heap, (filled + size, rows + n, s))
    return shard, start


def assign_shards(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", oversplit: int = 64, per_range: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("_d"),
            F.monotonically_increasing_id().alias("_tie"),
        )
    )
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    splitters, totals = split_points(rows, total, n_shards * oversplit, per_range)
    shard, start = deal(totals, n_shards, len(splitters) + 1)
    rank = F.expr("row_number() over (partition by _piece order by _h, _d, _tie)")
    return _ranged(rows, splitters, start, shard).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
