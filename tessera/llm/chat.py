"""Chat formatting by columnar byte assembly: segment lengths, their cumulative offsets and scatter indices are numpy
arrays; headers and escaped contents are copied into one preallocated Arrow buffer a batch.

A turn reads ``### role <turn>\\ntext</turn>\\n``. In roles and texts a backslash goes before every backslash, ``#`` and
``<``; so an unescaped ``#`` or ``<`` is markup, and the format is reversible whatever a text says. Loss spans are the
byte ranges of the assistant's escaped texts.

Rows are sorted by conversation and turn within partitions and streamed; a conversation that spans batches comes out as
parts, numbered in order, so a very long one never has to fit in memory.

Defined results: a null text or role is empty; turns without a number come last; rows with equal turns are ordered by
role, then text; a null conv_id is a conversation of its own; an empty table gives only the given extra rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

HEAD, MIDDLE, TAIL = b"### ", b" <turn>\n", b"</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\\#<")] = True
_BACKSLASH, _OPEN = ord("\\"), ord("<")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and its n + 1 offsets into them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with their escapes, and the offsets of the same segments there."""
    shift = np.cumsum(_ESCAPED[data])
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), _BACKSLASH, np.uint8)
    out[np.arange(len(data)) + shift] = data
    return out, offsets + np.concatenate([[0], shift])[offsets]


def _leads(data: np.ndarray) -> np.ndarray:
    """True of the backslashes that escape the next byte: those at even places of a run of backslashes."""
    slash = data == _BACKSLASH
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at
    return slash & ((at - other) % 2 == 1)


def unescape(data: np.ndarray) -> bytes:
    return data[~_leads(data)].tobytes()


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies each segment of ``data`` to its place in ``out``."""
    size = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(to - offsets[:-1], size)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, n + 1 offsets of the turns in it, first and last byte of every text in it)."""
    role, role_at = escape(*_bytes_of(roles))
    text, text_at = escape(*_bytes_of(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(len(HEAD) + n_role + len(MIDDLE) + n_text + len(TAIL))
    offsets = np.concatenate([[0], ends])
    out = np.empty(int(offsets[-1]), np.uint8)
    role_to = offsets[:-1] + len(HEAD)
    text_to = role_to + n_role + len(MIDDLE)
    for mark, to in ((HEAD, offsets[:-1]), (MIDDLE, role_to + n_role), (TAIL, text_to + n_text)):
        out[to[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_to, role, role_at)
    _scatter(out, text_to, text, text_at)
    return out, offsets, text_to, text_to + n_text


def _formatted(batches, rows=1_000):
    """Rows sorted by conversation and turn -> conv_id, part, n_turns, formatted and loss_spans."""
    last, part = (), 0
    for b in slices(batches, rows):
        n = b.num_rows
        if not n:
            continue
        out, offsets, lo, hi = assemble(b.column("role"), b.column("text"))
        conv = b.column("conv_id").to_pylist()
        starts = [0, *(i for i in range(1, n) if conv[i] != conv[i - 1])]
        ends = [*starts[1:], n]
        parts = []
        for s in starts:
            part = part + 1 if last == (conv[s],) else 0
            last = (conv[s],)
            parts.append(part)
        cut = offsets[[*starts, n]]
        formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        loss = np.asarray([r == LOSS_ROLE for r in b.column("role").to_pylist()])
        base = np.repeat(cut[:-1], np.diff([*starts, n]))
        spans = pa.StructArray.from_arrays([pa.array((lo - base)[loss]), pa.array((hi - base)[loss])], names=["start", "stop"])
        n_loss = np.concatenate([[0], np.cumsum(loss)])[[*starts, n]].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv[s] for s in starts], pa.int64()), pa.array(parts, pa.int64()), pa.array(np.subtract(ends, starts), pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(n_loss), spans)],
            names=["conv_id", "part", "n_turns", "formatted", "loss_spans"],
        )


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, n_turns, formatted and loss_spans (byte ranges) of every conversation, parts in order."""
    def string(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    given = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted, "conv_id long, part long, n_turns long, formatted string, loss_spans array<struct<start: long, stop: long>>")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted part."""
    data = np.frombuffer(formatted, np.uint8)
    free = np.ones(len(data), bool)
    free[1:] = ~_leads(data)[:-1]
    marks = np.flatnonzero((data == _OPEN) & free).reshape(-1, 2)
    out, at = [], 0
    for opens, closes in marks.tolist():
        out.append((unescape(data[at + len(HEAD) : opens - 1]), unescape(data[opens + len(MIDDLE) - 1 : closes])))
        at = closes + len(TAIL)
    return out


def _read_back(batches):
    """Parts in order -> one row of digests a conversation, all from the formatted text and its loss mask."""
    now, rows = None, []

    def ended():
        conv, n, turns, loss_chars, loss, chars = now
        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def batch():
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in slices(batches):
        for r in b.to_pylist():
            if r["part"] == 0:
                if now:
                    ended()
                now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = r["formatted"].encode()
            for role, text in parse(raw):
                now[1] += 1
                now[2].update(role + b"\n" + text + b"\n")
            data = np.frombuffer(raw, np.uint8)
            for span in r["loss_spans"]:
                text = unescape(data[span["start"] : span["stop"]])
                now[3] += len(text.decode())
                now[4].update(text)
            now[5] += len(r["formatted"])
        if rows:
            yield batch()
            rows = []
    if now:
        ended()
        yield batch()


def digests(turns: DataFrame, **cols: str) -> DataFrame:
    """What reads back from the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars. Runs in the tasks that format, on their output as it comes."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(turns, **cols).mapInArrow(_read_back, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose two texts are control strings."""
    probe = turns.sparkSession.createDataFrame([(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<]', '', 'g')) + 20 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
