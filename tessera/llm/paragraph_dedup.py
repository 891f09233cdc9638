"""Substring dedup by paragraph MinHash banding: paragraphs whose bands collide are verified by exact Jaccard, linked and
clustered by components; of every cluster the first occurrence stays, and repeats of ``MIN_WORDS`` words or more go.

What repeats needn't begin or end with a line. So paragraphs are cut by content, over the words alone (A-Z lower-cased,
line ends ignored): of every ``MIN_WORDS - PARAGRAPH + 1`` successive three-word grams the one of the smallest hash
begins a paragraph, which is ``PARAGRAPH`` words long. Equal runs of ``MIN_WORDS`` words thus hold an equal paragraph,
wherever they lie. Every paragraph enters the band index, those that overlap others too; but a key under which only
paragraphs meet that overlap one another in one text, or in copies of it, links nothing.

* Paragraphs with the same words share every band; they are one class from the start, named by a 64-bit hash, and meet
  the index once a batch of texts.
* Bands are tuned for a recall of ``RECALL`` at a Jaccard similarity of ``SIMILARITY`` over five-word shingles. Classes
  under one key are linked by a spanning forest of verified links, never by all pairs; sets of classes that meet under
  several keys are verified once; the members of a key with more than ``HOT`` classes are divided by finer bands first.
* Removed are: runs of successive paragraphs that each occurred before, of ``MIN_WORDS`` words or more; and, as an exact
  step around the ends of all such runs, longer or shorter, each run of ``MIN_WORDS`` words, compared whole by 128 bits,
  that occurred before. So a passage goes from its first word to its last.

Texts never move: a pass over them that needs to know which classes matter asks a sieve of ``2 ** SIEVE_BITS`` bits, the
same at any size of the table. It may let more through, which joins then leave out; the fuller it is the more.

Defined results: null, blank and short texts have no paragraphs; a null doc_id sorts first; rows that agree in id and
text are one document and get one decision; occurrences of equal or near-equal paragraphs that overlap one another
(``a b a b ...``) are one, and of equal ones the first by (doc_id, text hash, position) stays; an empty table gives an empty result; extra columns stay
with ``remove_repeats``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import drop_stage, slices, stage
from tessera.llm.components import components

SHINGLE, SIMILARITY, RECALL, MIN_WORDS, PARAGRAPH, CUT = 5, 0.8, 0.99, 50, 25, 3
#: A pair of this similarity is background; a band shape may let at most BACKGROUND_RATE of such pairs collide.
BACKGROUND, BACKGROUND_RATE = 0.03, 0.1
#: Classes under one key beyond which finer bands divide them; rows of those bands; classes held at once before that.
HOT, FINE_ROWS, HELD = 256, 3, 4096
#: Keys of at most so many classes compare all their pairs, many keys at once.
FEW = 6
SIEVE_BITS = 26
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_M = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1
_LOW = -(2**63)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, least_rows: int = 1) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band that keep background pairs rare, and the bands that reach the recall."""
    for rows in range(least_rows, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if 1 - (1 - BACKGROUND**rows) ** bands <= BACKGROUND_RATE:
            return bands, rows
    raise ValueError("no band shape reaches that recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random value for each byte, the same for A-Z and a-z, zero for white space."""
    lower = np.arange(256)
    lower[ord("A") : ord("Z") + 1] += 32
    out = np.random.default_rng(17).integers(1, 2**63, 256, np.uint64)[lower] | np.uint64(1)
    out[[32, *range(9, 14)]] = 0
    return out


_BYTES = _byte_values()


def _powers(by: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), by, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_POWERS = _powers(_M, 64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, text, place): the hash of every word of ``texts``, end to end, its text's number and its place in there. A
    word's hash is a polynomial in its bytes, computed for all bytes at once."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    value = _BYTES[data]
    inside = value != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first_bytes = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    begins[first_bytes] = inside[first_bytes]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    length = np.diff(np.r_[at, len(data)])  # with the white space behind, whose values are zero
    power = _BYTE_POWERS if length.max() <= len(_BYTE_POWERS) else _powers(_M, int(length.max()))
    value[at[0] :] *= power[np.arange(at[0], len(data)) - np.repeat(at, length)]
    h = _mix(np.add.reduceat(value, at))
    text = np.searchsorted(offsets - offsets[0], at, side="right") - 1
    of = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    return h, text, np.arange(len(at)) - np.repeat(of, np.diff(np.r_[of, len(at)]))


def _rolled(h: np.ndarray, size: int, by: int = _M) -> np.ndarray:
    """Hash of the ``size`` values from each place on: a polynomial, by doubling."""
    out, have, block, width = None, 0, h, 1
    while True:
        power = np.uint64(pow(by, width, 1 << 64))
        if size & width:
            out = block if out is None else out[: len(block) - have] * power + block[have:] if len(block) > have else out[:0]
            have += width
        if 2 * width > size:
            return _mix(out)
        block = block[: max(0, len(block) - width)] * power + block[width:]
        width *= 2


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of the ``size`` values from each place on."""
    have = 1
    while 2 * have <= size:
        x, have = best(x[: len(x) - have], x[have:]), 2 * have
    rest = size - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def _cuts(h: np.ndarray, text: np.ndarray, run: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, once): the words at which paragraphs begin, and whether each is the first of its class here, which enters the
    band index for it. An equal run of ``run`` words holds a paragraph that begins at its smallest gram, whose hash it
    shares."""
    none = np.empty(0, np.int64), np.empty(0, bool)
    if len(h) < run:
        return none
    width = run - size + 1
    whole = text[: len(text) - run + 1] == text[run - 1 :]
    grams = _rolled(h, CUT)[: len(whole) + width - 1]
    least = np.where(whole, _sliding(grams, width, np.minimum), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _sliding(np.concatenate([pad, least, pad]), width, np.maximum))
    if not len(at):
        return none
    once = np.zeros(len(at), bool)
    once[np.unique(_rolled(h, size)[at], return_index=True)[1]] = True
    return at, once


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d and th, which name a document, and its text."""
    return docs.select(*_name(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _name(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def paragraphs(given: DataFrame, run: int = MIN_WORDS, size: int = PARAGRAPH) -> DataFrame:
    """h (class), d, th, seq (index among the document's paragraphs), pos (first word) and to (behind the last word) of
    every paragraph; equal ones of a document that overlap one another are one."""

    def emit(batches):
        for b in slices(batches):
            h, text, place = _words(b.column("text"))
            at, _ = _cuts(h, text, run, size)
            if not len(at):
                continue
            classes = _rolled(h, size)[at]
            order = np.lexsort((at, classes, text[at]))
            at, classes = at[order], classes[order]
            new = np.r_[True, (classes[1:] != classes[:-1]) | (text[at[1:]] != text[at[:-1]]) | (at[1:] - at[:-1] >= size)]
            first = np.flatnonzero(new)
            to = place[at[np.r_[first[1:], len(at)] - 1]] + size
            order = np.argsort(at[first], kind="stable")
            at, classes, to = at[first][order], classes[first][order], to[order]
            of = np.flatnonzero(np.r_[True, text[at[1:]] != text[at[:-1]]])
            seq = np.arange(len(at)) - np.repeat(of, np.diff(np.r_[of, len(at)]))
            take = pa.array(text[at])
            yield pa.RecordBatch.from_arrays(
                [_signed(classes), b.column("d").take(take), b.column("th").take(take), pa.array(seq, pa.int32()), pa.array(place[at], pa.int32()), pa.array(to, pa.int32())],
                names=["h", "d", "th", "seq", "pos", "to"],
            )

    return given.mapInArrow(emit, "h long, d long, th long, seq int, pos int, to int")


def _band_keys(shingles: np.ndarray, bands: int, rows: int, least) -> np.ndarray:
    """(paragraphs, bands) keys; ``least`` takes the smallest of each paragraph's values, given those of all shingles."""
    rng = np.random.default_rng(11)
    out = []
    for b in range(bands):
        key = None
        for _ in range(rows):
            odd, add = rng.integers(1, 2**63, 2, np.uint64)
            value = least(_mix(shingles * (odd | np.uint64(1)) + add))
            key = value if key is None else _mix(key * np.uint64(_M) + value)
        out.append(_mix(key + np.uint64((b + 1) * _M & _U64)))
    return np.stack(out, axis=1)


def band_keys(given: DataFrame, bands: int, rows: int, run: int = MIN_WORDS, size: int = PARAGRAPH) -> DataFrame:
    """(key, h, beside) for each band of each paragraph, once a slice of the texts. ``beside`` names the classes of all the
    paragraphs there that overlap one another and share the key."""

    def emit(batches):
        for b in slices(batches):
            h, text, _ = _words(b.column("text"))
            at, _ = _cuts(h, text, run, size)
            if not len(at):
                continue
            classes = _rolled(h, size)[at]
            keys = _band_keys(_rolled(h, SHINGLE), bands, rows, lambda x: _sliding(x, size - SHINGLE + 1, np.minimum)[at])  # noqa: B023
            beside = np.empty(keys.shape, np.int32)
            for k in range(bands):
                same = np.r_[False, (keys[1:, k] == keys[:-1, k]) & (text[at[1:]] == text[at[:-1]])]
                begun = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
                part = (at - begun) // size  # of a long row of equal keys, those that all overlap
                first = np.flatnonzero(~same | np.r_[False, part[1:] != part[:-1]])
                beside[:, k] = np.repeat(_mix(np.add.reduceat(_mix(classes), first)), np.diff(np.r_[first, len(at)])).astype(np.uint32).view(np.int32)
            keys, classes, beside = keys.ravel(), np.repeat(classes, bands), beside.ravel()
            order = np.lexsort((beside, classes, keys))
            keys, classes, beside = keys[order], classes[order], beside[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]) | (beside[1:] != beside[:-1])]
            yield pa.RecordBatch.from_arrays([_signed(keys[new]), _signed(classes[new]), pa.array(beside[new])], names=["key", "h", "beside"])

    return given.mapInArrow(emit, "key long, h long, beside int")


def shingle_sets(given: DataFrame, wanted: Column | None, run: int = MIN_WORDS, size: int = PARAGRAPH) -> DataFrame:
    """h and its shingles' hashes, sorted, for the classes that pass the sieve ``wanted``."""

    def emit(batches):
        for b in slices(batches):
            h, text, _ = _words(b.column("text"))
            at, once = _cuts(h, text, run, size)
            if not len(at):
                continue
            at = at[once]
            classes = _rolled(h, size)[at]
            hit = _passes(wanted.value, classes.view(np.int64))
            at = at[hit]
            n = size - SHINGLE + 1
            sets = np.sort(_rolled(h, SHINGLE)[at[:, None] + np.arange(n)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [_signed(classes[hit]), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), _signed(sets.ravel()))], names=["h", "s"]
            )

    return given.mapInArrow(emit, "h long, s array<long>")


def _sieve(hashes: DataFrame):
    """A broadcast bit array that holds the long column ``h``: two bits of each value are set. Its size is fixed."""
    place = [F.col("h").bitwiseAND((1 << SIEVE_BITS) - 1), F.shiftrightunsigned("h", 64 - SIEVE_BITS)]
    bits = hashes.select(F.explode(F.array(*place)).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out)


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in (h & ((1 << SIEVE_BITS) - 1), (h.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)):
        out &= (sieve[p >> 6] >> (p & 63)) & 1 == 1
    return out


def _collisions(batches):
    """(key, h, beside), sorted -> (sig, key, h) of the keys of two classes or more that are not all beside one another.
    ``sig`` names the set of classes; a key of more than HELD rows is handed on as it comes, under a name of its own."""
    keys = h = np.empty(0, np.int64)
    beside = np.empty(0, np.int32)
    large = large_h = None

    def made(sig, k, x):
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(k), pa.array(x)], names=["sig", "key", "h"])

    def groups(k, x, y):
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
        n = np.add.reduceat(new.astype(np.int64), first)
        met = (n > 1) & (np.minimum.reduceat(y, first) != np.maximum.reduceat(y, first))
        sig = _mix(np.add.reduceat(np.where(new, _mix(x.view(np.uint64)), np.uint64(0)), first) + n.astype(np.uint64)).view(np.int64)
        rows = np.diff(np.r_[first, len(k)])
        some = np.repeat(met, rows) & new
        return made(np.repeat(sig, rows)[some], k[some], x[some])

    def distinct(k, x, before=None):
        new = np.r_[before is None or x[0] != before, x[1:] != x[:-1]]
        return made(k[new], k[new], x[new])

    for b in batches:
        k, x, y = (b.column(c).to_numpy() for c in ("key", "h", "beside"))
        if large is not None and len(k):
            n = int(np.searchsorted(k, large, side="right"))
            if n:
                yield distinct(k[:n], x[:n], large_h)
                large_h = x[n - 1]
            k, x, y = k[n:], x[n:], y[n:]
            large = None if len(k) else large
        if not len(k):
            continue
        keys, h, beside = np.concatenate([keys, k]), np.concatenate([h, x]), np.concatenate([beside, y])
        new = np.r_[True, (keys[1:] != keys[:-1]) | (h[1:] != h[:-1]) | (beside[1:] != beside[:-1])]
        keys, h, beside = keys[new], h[new], beside[new]
        two = np.r_[False, (keys[1:] == keys[:-1]) & (h[1:] == h[:-1])]
        new = ~(two & np.r_[False, two[:-1]])  # two of a class tell that it is beside different ones
        keys, h, beside = keys[new], h[new], beside[new]
        ended = int(np.searchsorted(keys, keys[-1], side="left"))
        if ended:
            yield groups(keys[:ended], h[:ended], beside[:ended])
        keys, h, beside = keys[ended:], h[ended:], beside[ended:]
        if len(keys) > HELD:
            yield distinct(keys, h)
            large, large_h, keys, h, beside = keys[0], h[-1], keys[:0], h[:0], beside[:0]
    if len(keys) > 1:
        yield groups(keys, h, beside)


def _sets_of(b: pa.RecordBatch) -> np.ndarray:
    return b.column("s").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)


def _divided(bands: int, rows: int):
    """(key, h, s) -> the same under finer keys, those of bands of more rows."""

    def emit(batches):
        for b in slices(batches, 4096):
            sets = _sets_of(b)
            if not len(sets):
                continue
            fine = _band_keys(sets.ravel(), bands, rows, lambda x: x.reshape(sets.shape).min(axis=1))  # noqa: B023
            key = _mix(fine + b.column("key").to_numpy().view(np.uint64)[:, None])
            again = pa.array(np.repeat(np.arange(b.num_rows), bands))
            yield pa.RecordBatch.from_arrays([_signed(key.ravel()), b.column("h").take(again), b.column("s").take(again)], names=["key", "h", "s"])

    return emit


def _forest(h: np.ndarray, sets: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links: a class that is linked leaves the rest at once. ``sets``: sorted rows."""
    new = np.ones(sets.shape, bool)
    new[:, 1:] = sets[:, 1:] != sets[:, :-1]
    size = new.sum(axis=1)
    a, b, rest = [], [], np.arange(len(h))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            own = sets[x][new[x]]
            at = np.minimum(np.searchsorted(own, sets[rest]), len(own) - 1)
            both = ((own[at] == sets[rest]) & new[rest]).sum(axis=1)
            hit = both >= similarity * (size[x] + size[rest] - both)
            if hit.any():
                a.append(np.full(int(hit.sum()), h[x]))
                b.append(h[rest[hit]])
                todo.extend(rest[hit].tolist())
                rest = rest[~hit]
    return a, b


def _pairs(h: np.ndarray, sets: np.ndarray, group: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of all links within groups, which are numbered in order and have FEW members at most."""
    distinct = lambda x: 1 + (x[:, 1:] != x[:, :-1]).sum(axis=1)
    size, a, b = distinct(sets), [], []
    for k in range(1, FEW):
        i = np.flatnonzero(group[k:] == group[:-k])
        if not len(i):
            break
        either = distinct(np.sort(np.concatenate([sets[i], sets[i + k]], axis=1), axis=1))
        hit = i[size[i] + size[i + k] - either >= similarity * either]
        a.append(h[hit])
        b.append(h[hit + k])
    return a, b


def _verified(similarity: float):
    """(key, h, s) sorted by key -> edges (a, b) between near-equal classes under one key."""

    def made(a, b):
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def links(held):
        yield from made(*_forest(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), similarity))

    def emit(batches):
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for b in batches:
            keys, h = b.column("key").to_numpy(), b.column("h").to_numpy()
            if not len(keys):
                continue
            sets = _sets_of(b)
            cut = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            n = np.diff(cut)
            few = n <= FEW
            few[[0, -1]] = False  # what goes on in other batches
            rows = np.repeat(few, n)
            yield from made(*_pairs(h[rows], sets[rows], np.repeat(np.arange(len(n)), n)[rows], similarity))
            for lo, hi in zip(cut[:-1][~few].tolist(), cut[1:][~few].tolist(), strict=True):
                if held and held[0][0] != keys[lo]:
                    yield from links(held)
                    held = []
                held.append((keys[lo], h[lo:hi], sets[lo:hi]))
        if held:
            yield from links(held)

    return emit


def links(given: DataFrame, similarity: float, recall: float, run: int = MIN_WORDS, size: int = PARAGRAPH) -> DataFrame:
    """Edges (a, b) that connect just the classes that near-equal ones under a common band connect, but for those that
    only meet where they overlap."""
    keys = band_keys(given, *tune_bands(similarity, recall), run, size)
    met = stage(keys.repartition("key").sortWithinPartitions("key", "h", "beside").mapInArrow(_collisions, "sig long, key long, h long"))
    once = met.groupBy("sig").agg(F.min("key").alias("key"))
    members = stage(met.join(once, ["sig", "key"]).select("key", "h"))
    drop_stage(met)
    wanted = _sieve(members.select("h"))
    sets = stage(shingle_sets(given, wanted, run, size).groupBy("h").agg(F.min("s").alias("s")))
    hot = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
    cold = members.join(hot, "key", "left_anti").join(sets, "h").select("key", "h", "s")
    fine = members.join(hot, "key", "left_semi").join(sets, "h").select("key", "h", "s").mapInArrow(_divided(*tune_bands(similarity, recall, FINE_ROWS)), "key long, h long, s array<long>")
    edges = stage(cold.unionByName(fine).repartition("key").sortWithinPartitions("key").mapInArrow(_verified(similarity), "a long, b long"))
    drop_stage(members, sets)
    wanted.destroy()
    return edges


def _spans(paras: DataFrame, named: DataFrame) -> DataFrame:
    """d, th, pos, to, cluster_id and kept (d, th, pos of what stays) of the runs of successive paragraphs that occurred
    before, of any length; heads and tails: classes of the first and the last paragraph."""
    found = stage(paras.join(named, "h"))
    kept = found.groupBy("cluster_id").agg(F.min(F.struct("d", "th", "pos", "to")).alias("kept"))
    here = (F.col("d") == F.col("kept.d")) & (F.col("th") == F.col("kept.th"))
    # near-equal paragraphs may overlap: what hangs together with the first occurrence is one with it
    several = named.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    own = "partition by cluster_id order by pos, to"
    one = found.join(several, "cluster_id", "left_semi").join(kept, "cluster_id").where(here)
    one = one.withColumn("_apart", F.expr(f"coalesce(pos >= max(to) over ({own} rows between unbounded preceding and 1 preceding), false)"))
    one = one.withColumn("_apart", F.expr(f"max(_apart) over ({own} rows unbounded preceding)")).where("not _apart")
    kept = kept.join(one.groupBy("cluster_id").agg(F.max("to").alias("_until")), "cluster_id", "left")
    again = found.join(kept, "cluster_id").where(~(here & (F.col("pos") < F.coalesce("_until", "kept.to")))).dropDuplicates(["d", "th", "pos"])
    runs = again.withColumn("_run", F.expr("seq - row_number() over (partition by d, th order by seq)"))
    ends = [F.min(F.struct("pos", "h", "cluster_id", "kept")).alias("_first"), F.max(F.struct("pos", "h")).alias("_last"), F.max("to").alias("to"), F.collect_set("h").alias("_all")]
    return runs.groupBy("d", "th", "_run").agg(*ends).select(
        "d", "th", F.col("_first.pos").alias("pos"), "to", F.col("_first.cluster_id").alias("cluster_id"), F.col("_first.kept").alias("kept"),
        F.col("_first.h").alias("head"), F.col("_last.h").alias("tail"), "_all",
    )


def _runs_at(edges, run: int, size: int):
    """Texts -> (g, g2, d, th, pos, to): hash and place of each run of ``run`` words that holds a paragraph of a class
    that passes the sieve; to: the end of the last of the equal occurrences that overlap one another."""

    def emit(batches):
        for b in slices(batches):
            h, text, place = _words(b.column("text"))
            at, _ = _cuts(h, text, run, size)
            at = at[_passes(edges.value, _rolled(h, size)[at].view(np.int64))] if len(at) else at
            if not len(at):
                continue
            inside = np.zeros(len(h) - run + 2, np.int64)
            np.add.at(inside, np.maximum(at + size - run, 0), 1)
            np.add.at(inside, np.minimum(at, len(h) - run) + 1, -1)
            whole = text[: len(text) - run + 1] == text[run - 1 :]
            at = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & whole)
            g, g2 = _rolled(h, run)[at], _rolled(_mix(h), run, 0xD6E8FEB86659FD93)[at]
            order = np.lexsort((at, g2, g, text[at]))
            at, g, g2 = at[order], g[order], g2[order]
            of = text[at]
            new = np.r_[True, (g[1:] != g[:-1]) | (g2[1:] != g2[:-1]) | (of[1:] != of[:-1]) | (at[1:] - at[:-1] >= run)][: len(at)]
            first = np.flatnonzero(new)
            to = place[at[np.r_[first[1:], len(at)] - 1]] + run
            take = pa.array(of[first])
            yield pa.RecordBatch.from_arrays(
                [_signed(g[first]), _signed(g2[first]), b.column("d").take(take), b.column("th").take(take), pa.array(place[at[first]], pa.int32()), pa.array(to, pa.int32())],
                names=["g", "g2", "d", "th", "pos", "to"],
            )

    return emit


def _exact_runs(given: DataFrame, edges, run: int, size: int) -> DataFrame:
    """d, th, pos, to, cluster_id and kept of the runs of just ``run`` words that occurred before."""
    runs = stage(given.mapInArrow(_runs_at(edges, run, size), "g long, g2 long, d long, th long, pos int, to int"))
    place = F.struct("d", "th", "pos", "to")
    kept = runs.groupBy("g", "g2").agg(F.min(place).alias("kept"), F.max(place).alias("_last")).where("kept != _last").drop("_last")
    again = runs.join(kept, ["g", "g2"]).where(place != F.col("kept"))
    return again.select("d", "th", "pos", "to", F.col("g").alias("cluster_id"), "kept")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS, paragraph: int = PARAGRAPH) -> DataFrame:
    """The spans to remove, disjoint: d, th, first_word (its index among the document's words), n_words, cluster_id, and
    kept (d, th and pos of a document in which the words at the beginning stay)."""
    given = _given(docs, id_col, text_col)
    paras = stage(paragraphs(given, min_words, paragraph))
    edges = links(given, similarity, recall, min_words, paragraph)
    linked = components(edges)
    root = linked.select(F.col("a").alias("h"), "root").unionByName(linked.select(F.col("root").alias("h"), "root").distinct())
    shared = paras.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    named = stage(shared.join(root, "h", "full_outer").select("h", F.coalesce("root", "h").alias("cluster_id")))
    spans = stage(_spans(paras, named))
    drop_stage(paras, edges)
    long = F.col("to") - F.col("pos") >= min_words
    ends = spans.select(F.explode(F.when(long, F.array("head", "tail")).otherwise(F.col("_all"))).alias("h")).distinct()
    sieve = _sieve(ends)
    near = spans.where(long).select("d", "th", "pos", "to", "cluster_id", "kept")
    both = stage(near.unionByName(_exact_runs(given, sieve, min_words, paragraph)))
    sieve.destroy()
    one = "partition by d, th order by pos, to"
    opens = both.withColumn("_open", F.expr(f"coalesce(pos > max(to) over ({one} rows between unbounded preceding and 1 preceding), true)"))
    opens = opens.withColumn("_run", F.expr(f"sum(cast(_open as int)) over ({one} rows unbounded preceding)"))
    whole = opens.groupBy("d", "th", "_run").agg(F.min(F.struct("pos", "cluster_id", "kept")).alias("x"), F.max("to").alias("to"))
    return whole.select("d", "th", F.col("x.pos").alias("first_word"), (F.col("to") - F.col("x.pos")).alias("n_words"), "x.cluster_id", "x.kept")


def report(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each span to remove: doc_id, first_word, n_words, cluster_id, and kept_doc_id and kept_word, where the
    words at its beginning stay."""
    name = lambda c: F.expr(f"nullif({c}, {_LOW}L)")
    found = repeats(docs, id_col=id_col, **how)
    return found.select(name("d").alias("doc_id"), "first_word", "n_words", "cluster_id", name("kept.d").alias("kept_doc_id"), F.col("kept.pos").alias("kept_word"))


def _cut(text: bytes, runs: list[dict]) -> bytes:
    """``text`` without the words of ``runs``; a line left without a word by that goes."""
    out, k = [], 0
    for line in text.split(b"\n"):
        at = [m.span() for m in _WORD.finditer(line)]
        k, first = k + len(at), k
        stays = [True] * len(at)
        for r in runs:
            lo, hi = max(r["first_word"], first) - first, min(r["first_word"] + r["n_words"], k) - first
            stays[max(lo, 0) : max(hi, 0)] = [False] * max(0, hi - lo)
        if all(stays):
            out.append(line)
        elif any(stays):
            ends = [x for x, _ in at[1:]] + [len(line)]
            left = line[: at[0][0]] + b"".join(line[lo:hi] for (lo, _), hi, s in zip(at, ends, stays, strict=True) if s)
            out.append(left if stays[-1] else left.rstrip())
    return b"\n".join(out)


@F.arrow_udf(StringType())
def _cut_texts(text: pa.Array, runs: pa.Array) -> pa.Array:
    rows = zip(text.cast(pa.binary()).to_pylist(), runs.to_pylist(), strict=True)
    return pa.array([None if t is None else _cut(t, r) for t, r in rows], pa.binary()).cast(pa.string())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the repeated spans; documents of which no word is left by that go. ``n_chars`` follows the text."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **how)
    marks = stage(found.groupBy("d", "th").agg(F.collect_list(F.struct("first_word", "n_words")).alias("_runs")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col(f"_row.`{text_col}`")
    joined = docs.select(row, *_name(id_col, text_col)).join(marks, ["d", "th"], "left")
    joined = joined.withColumn("_cut", _cut_texts(F.when(F.col("_runs").isNotNull(), text), F.col("_runs")))
    joined = joined.select("_row", F.col("_runs").isNull().alias("_as_was"), F.when(F.col("_runs").isNull(), text).otherwise(F.col("_cut")).alias("_text"))
    out = []
    for c in docs.columns:
        col = F.col(f"_row.`{c}`")
        if c == text_col:
            col = F.col("_text")
        elif c == "n_chars":
            col = F.when(F.col("_as_was"), col).otherwise(F.length("_text")).cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return joined.where(F.col("_as_was") | F.col("_text").rlike(r"[^\x20\x09-\x0D]")).select(*out)
