"""Packing documents into sequences: a configuration linear program over the histogram of piece lengths, solved by
multiplicative weights with a knapsack that prices patterns, then rounded.

Only the histogram (at most ``CAPACITY`` counts) reaches the driver. The program's answer is a list of patterns, each
used some number of times; pieces of one length are numbered by a distributed rank, and rank intervals are dealt to the
patterns' places, so no task holds more than its share of pieces.

Defined results: a null or empty text is one piece of the end token; repeated rows are packed each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stage

CAPACITY, END_ID = 1024, 2
#: Rows numbered together, about.
RANK_ROWS = 4096
#: Rounds of the weights; share of a length that one use covers; how near to the best a pattern must be; rate at which
#: cover lowers weights; share of what is left that one answer packs.
ROUNDS, STEP, NEAR, ETA, PART = 14, 0.25, 0.02, 0.5, 0.3
#: Of pieces of at most 1/SMALL of the capacity the share SPARE stays out of the program, to fill its last gaps.
SMALL, SPARE = 4, 0.15
LOSS = 0.01

# The vocabulary's own split, for texts of ASCII and Latin letters only; any other text goes to the tokenizer whole.
_L, _S = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", "\\t-\\r "
_OTHER = re.compile(f"[^{_S}!-~{_L}]|<\\|endoftext\\|>")
_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Parts of a split whose ids a worker remembers: it keeps them, and the tokenizer, as long as it lives.
_KNOWN_WORDS = 100_000


class _Ids(dict):
    """Little-endian ids of a split's part, remembered while there is room. ``encode`` gives a part's list of ids."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.encode(part)).tobytes()
        if len(self) < _KNOWN_WORDS:
            self[part] = ids
        return ids


@cache
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _known(path: str) -> _Ids:
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):  # the same vocabulary as ranks: a part's ids are the same and come several times faster
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return _Ids(tiktoken.Encoding("parts", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={}).encode_ordinary)
    return _Ids(lambda part: _whole(path).encode(part, add_special_tokens=False).ids)


def token_ids(text: str | None, path: str) -> bytes:
    """Ids of a text as little-endian 32-bit integers, the end id included."""
    text = text or ""
    if _OTHER.search(text):
        body = np.asarray(_whole(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    else:
        known = _known(path)
        body = b"".join(map(known.__getitem__, _SPLIT.findall(text)))
    return body + np.asarray([END_ID], "<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, tie (tells repeated rows apart), piece, start, length and ids_crc32. The first piece may be shorter."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        for b in slices(batches):
            rows, firsts, lengths, crcs, numbers = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = token_ids(text, path)
                n = len(ids) // 4
                at = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    rows.append(i)
                    numbers.append(k)
                    firsts.append(lo)
                    lengths.append(hi - lo)
                    crcs.append(zlib.crc32(ids[4 * lo : 4 * hi]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("tie").take(take), pa.array(numbers, pa.int32()), pa.array(firsts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "tie", "piece", "start", "length", "ids_crc32"],
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(cut, "doc_id long, tie long, piece int, start long, length long, ids_crc32 long")


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value of every room, and the piece to put there first (0:
    leave one place empty). Of equally good pieces the longest, so that short ones stay to fill gaps."""
    value, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = price[::-1]
    for room in range(1, capacity + 1):
        gain = back[capacity - room : capacity] + value[:room]  # pieces room, room - 1, ..., 1
        k = int(np.argmax(gain))
        value[room], first[room] = (gain[k], room - k) if gain[k] > value[room - 1] + 1e-12 else (value[room - 1], 0)
    return value, first


def _pattern(size: int, first: np.ndarray, capacity: int) -> np.ndarray:
    """A piece of ``size`` and the best filling of the room beside it."""
    out, room = np.zeros(capacity + 1, np.int64), capacity - size
    out[size] = 1
    while room:
        piece = int(first[room])
        out[piece] += piece > 0
        room -= piece or 1
    return out


def _fill(left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern from what is left: the longest piece, then one or two that fill the room exactly, or else the longest
    that still fits, and so on."""
    out, room, free = np.zeros_like(left), capacity, left.copy()
    while room:
        fits = np.flatnonzero(free[: room + 1])
        if not len(fits):
            break
        sizes = [int(fits[-1])]
        if room < capacity and sizes[0] < room:
            half = fits[fits <= room // 2]
            pair = half[(free[room - half] > 0) & ((2 * half != room) | (free[half] > 1))]
            if len(pair):
                sizes = [int(pair[-1]), room - int(pair[-1])]
        for size in sizes:
            out[size] += 1
            free[size] -= 1
            room -= size
    return out


def _priced(need: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, float]]:
    """A fractional answer of the covering program: patterns with their uses, by multiplicative weights.

    A piece's weight starts at its share of the capacity. A round prices pieces by their weights, and of the patterns
    that the knapsack finds around each length takes those worth nearly the most; each is used until it covers a share
    ``STEP`` of its scarcest length. What a round covers then loses weight by as much.
    """
    size = np.arange(capacity + 1)
    some = np.flatnonzero(need > 0)[::-1].tolist()
    weight = np.where(need > 0, size / capacity, 0.0)
    total = np.maximum(need, 1)
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        value, first = _knapsack(weight, capacity)
        covered = np.zeros(capacity + 1)
        worth = weight[some] + value[[capacity - x for x in some]]
        least = (1 - NEAR) * worth.max()
        for x, w in zip(some, worth.tolist(), strict=True):
            if w >= least and covered[x] < STEP:
                pattern = np.minimum(_pattern(x, first, capacity), need)
                has = np.flatnonzero(pattern)
                use = STEP * float((need[has] / pattern[has]).min())
                covered[has] += use * pattern[has] / total[has]
                key = pattern.tobytes()
                used[key] = used.get(key, 0.0) + use
        weight *= np.exp(-ETA * covered)
        weight /= max(weight.max(), 1e-300)
    return [(np.frombuffer(k, np.int64), u) for k, u in used.items()]


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], int]:
    """``solve_program``'s answer; where nearly every sequence holds one long piece, so that there is little to choose and
    rounding loses, filling alone may need fewer sequences: it stands if that is ``LOSS`` of them or more."""
    out, n_program = solve_program(counts, capacity, rounds)
    left, plain = counts.astype(np.int64).copy(), []
    while left.any():
        pattern = _fill(left, capacity)
        has = np.flatnonzero(pattern)
        n = int((left[has] // pattern[has]).min())
        plain.append((pattern, n))
        left[has] -= n * pattern[has]
    return (plain, 0) if sum(n for _, n in plain) < (1 - LOSS) * sum(n for _, n in out) else (out, n_program)


def solve_program(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Patterns (copies of each length 0..capacity) and how often each is used, which together hold just ``counts``; and
    how many of those sequences, full pieces left out, the program gave.

    Of a fractional answer a part is used, rounded down, and the largest uses are then rounded up until ``PART`` of the
    pieces are packed. What is left is a program of its own, solved by the same pricing, with prices for what has become
    scarce, until its answer holds no full pattern. What no full pattern took, and the short pieces that were spared for
    it, are filled pattern by pattern.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if left[capacity]:
        full = np.zeros_like(left)
        full[capacity] = 1
        out.append((full, int(left[capacity])))
        left[capacity] = 0
    size = np.arange(capacity + 1)
    n_program = 0

    def take(pattern: np.ndarray, most: int) -> int:
        has = np.flatnonzero(pattern)
        n = min(most, int((np.maximum(left - spare, 0)[has] // pattern[has]).min()))
        if n > 0:
            out.append((pattern, n))
            left[has] -= n * pattern[has]
        return max(n, 0)

    spare = np.where(size <= capacity // SMALL, np.ceil(SPARE * left).astype(np.int64), 0)
    while True:
        need = np.maximum(left - spare, 0)
        if (need > 0).sum() < 2:
            break
        uses = _priced(need, capacity, rounds)
        mean = sum(float((p * size).sum()) * u for p, u in uses) / int((need * size).sum())
        whole = sorted(((p, u / mean) for p, u in uses if int((p * size).sum()) == capacity), key=lambda x: (-x[1], -int(np.flatnonzero(x[0])[-1])))
        before, quota = n_program, PART * int((need * size).sum()) / capacity
        for pattern, use in whole:
            n_program += take(pattern, int(use))
        for pattern, _ in whole:
            if n_program - before < quota:
                n_program += take(pattern, 1)
        if n_program == before:
            break
    spare[:] = 0
    while left.any():
        take(_fill(left, capacity), int(left.sum()))
    return out, n_program


def _places(patterns: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank intervals: (length << 40 | first rank) sorted, with the sequence of the first rank and the offset."""
    ranks: dict[int, int] = {}
    keys, sequences, offsets = [], [], []
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for size in np.flatnonzero(pattern)[::-1].tolist():
            for _ in range(int(pattern[size])):
                first = ranks.get(size, 0)
                keys.append(size << 40 | first)
                sequences.append(sequence)
                offsets.append(offset)
                ranks[size] = first + n
                offset += size
        sequence += n
    order = np.argsort(np.asarray(keys, np.int64), kind="stable")
    return tuple(np.asarray(x, np.int64)[order] for x in (keys, sequences, offsets))


def _ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with their rank (from 0) among the rows of their length. ``counts``: (length, n), CAPACITY rows at most."""
    parts = counts.select("length", F.expr(f"(n + {RANK_ROWS - 1}) div {RANK_ROWS}").alias("_parts"))
    dealt = rows.join(F.broadcast(parts), "length").withColumn("_part", F.expr("pmod(xxhash64(doc_id, piece, tie), _parts)"))
    before = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n")).select(
        "length", "_part", F.expr("sum(_n) over (partition by length order by _part rows unbounded preceding) - _n").alias("_before")
    )
    return dealt.join(before, ["length", "_part"]).withColumn("rank", F.expr("_before + row_number() over (partition by length, _part order by doc_id, piece, tie) - 1"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = stage(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity))
    counts = stage(rows.groupBy("length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.collect():
        histogram[r["length"]] = r["n"]
    keys, sequences, offsets = _places(solve(histogram, capacity)[0])

    def place(batches):
        for b in batches:
            size, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (size << 40) | rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offsets[at])], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return _ranked(rows, counts).select(*kept, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
