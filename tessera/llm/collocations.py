"""Phrase collocations by stripes.

A stripe is an associative counter: a prefix and, for each next word, how often it follows. Tasks count the windows of
whole texts into stripes and ship those, each prefix once with all its counters; stripes of one prefix are merged
elementwise. Prefixes grow level by level, from none to three words. A level takes only prefixes that are frequent, and
counts as their next word only one that makes a frequent end (a phrase is no commoner than its parts); other windows
are part of no candidate, and how often a prefix occurs is known from the level before. One structure gives all words
(the sum of the stripe without a prefix), the extensions (a stripe's entries), and the most frequent extension of each
phrase, to the right (its largest entry) and to the left (the largest entry that ends in the phrase).

Which phrases are frequent is told to the tasks by a bitmap of their hashes, sized by their number. It may let
infrequent phrases pass, which only costs work: every count that is reported is exact.

A phrase that any longer candidate subsumes is subsumed by one that is one word longer: what lies between a phrase and a
longer candidate occurs at least as often as that candidate, hence is a candidate itself.

Defined results: a null text is empty; a null lang is ``und``; a doc_id or any other column takes no part; repeated rows
count each time; texts of any length are read in parts, whole; a text without words adds nothing; an empty table gives
an empty result; of equally scored phrases the more frequent, then the smaller in UTF-8 byte order, comes first.
Memory: a task holds the windows of WINDOWS words, as 32-bit ids and one 64-bit key each, one text and the bitmap, of
MOST_BITS at most; windows are looked up, and stripes laid out, BLOCK at a time. Beyond MOST_BITS / 16 frequent phrases the
bitmap lets more pass. The stripe of a hot prefix, one with a HOT_SHARE-th of all words or more, is
cut into SLICES by its next words, so that it meets in several tasks; counts are merged before and after the shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stage
from tessera.llm.joins import join_hot

LEAST, MOST_WORDS, TOP, SUBSUMED_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000
#: Words whose windows a task counts before it ships the stripes, bytes of a text read at once, slices of a stripe.
WINDOWS, PART_BYTES, SLICES = 4_000_000, 8_000_000, 16
#: Windows, words and counters that a task handles at once.
BLOCK = 1 << 18
#: A prefix is hot from this many occurrences, and this share of all words, on: there are HOT_SHARE at most of each length.
HOT_LEAST, HOT_SHARE = 1_000, 20_000
#: Bits of the bitmap of frequent phrases, by their number, and at most.
BITS_EACH, MOST_BITS = 16, 2**28
_END = b"."  # ends a piece: it separates pieces, so no word is equal to it
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_SEPARATORS + b"\t", _END * len(_SEPARATORS) + b" ")
#: A stripe as it is shipped.
SHIPPED = "lang string, prefix string, slice int, next string, n array<int>"


class _Sieve:
    """Bitmap of the hashes of frequent phrases: two bits each."""

    MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplying by it loses nothing

    def __init__(self, size: int, bits: np.ndarray, hot: np.ndarray):
        self.size = size  # a power of two
        self.bits = bits
        self.hot = hot  # hashes of hot phrases

    @classmethod
    def places(cls, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return hashes & np.uint64(size - 1), (hashes >> np.uint64(32)) & np.uint64(size - 1)

    @classmethod
    def fold(cls, lang: str, words: list[np.ndarray]) -> np.ndarray:
        """Hash of each phrase from the hashes of its words."""
        out = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        for w in words:
            out = (out ^ w) * cls.MIX
            out ^= out >> np.uint64(29)
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes, self.size)
        bit = lambda p: (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
        return (bit(a) & bit(b)).astype(bool)


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _word_hashes(words: pa.Array) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i in range(0, len(words), BLOCK):
        part = words.slice(i, BLOCK)
        out[i : i + len(part)] = _hashes(part.to_pylist())
    return out


def _phrase_hashes(batch: pa.RecordBatch, m: int) -> np.ndarray:
    out = np.zeros(batch.num_rows, np.uint64)
    for lang in batch.column("lang").unique().to_pylist():
        own = pc.equal(batch.column("lang"), lang)
        split = [p.encode().split(b" ") for p in batch.column("phrase").filter(own).to_pylist()]
        out[own.to_numpy(zero_copy_only=False)] = _Sieve.fold(lang, [_hashes([w[k] for w in split]) for k in range(m)])
    return out


def _sieve(frequent: DataFrame, m: int, hot_from: float) -> _Sieve:
    """Of the phrases of ``m`` words in (lang, phrase, a); hot are those of ``hot_from`` occurrences."""
    n = frequent.count()
    size = min(MOST_BITS, max(64, 1 << (BITS_EACH * n - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.concatenate(_Sieve.places(_phrase_hashes(b, m), size))
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    told = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.uint64)
    bitmap[told.column("at").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    hot = frequent.where(F.col("a") >= hot_from).select("lang", "phrase").toArrow().combine_chunks().to_batches()
    return _Sieve(size, bitmap, _phrase_hashes(hot[0], m) if hot else np.empty(0, np.uint64))


class _Counter:
    """Words of one language since the last shipment. Windows are of ``m`` words."""

    def __init__(self, lang: str, m: int, sieve: _Sieve | None):
        self.lang, self.m, self.sieve = lang, m, sieve
        self.parts: list[tuple[pa.Array, np.ndarray]] = []
        self.size = 0

    def read(self, words: pa.Array, ids: np.ndarray):
        """More text, as ``tokens`` tells it."""
        self.parts.append((words, ids))
        self.size += len(ids)

    def ship(self, last: bool):
        """Stripes of the windows that start here; without ``last``, the words whose windows go on are kept."""
        if not self.parts:
            return
        every = pa.concat_arrays([w for w, _ in self.parts]).dictionary_encode()
        number = every.indices.to_numpy(zero_copy_only=False) + np.int32(1)
        ids, at, to = np.zeros(self.size + (self.m if last else 0), np.int32), 0, 0
        for w, own in self.parts:
            ids[to : to + len(own)] = np.append(np.int32(0), number[at : at + len(w)])[own]
            at, to = at + len(w), to + len(own)
        starts = max(0, len(ids) - (self.m - 1))
        words = pa.concat_arrays([pa.array([b""], pa.binary()), every.dictionary])  # id 0 ends a piece
        self.parts, self.size = [], 0
        del every, number
        if not last:
            tail = ids[starts:]
            self.read(words.take(pa.array(tail)), np.where(tail > 0, np.arange(1, len(tail) + 1), 0).astype(np.int32))
        columns, hot = self._windows(ids, starts, words)
        del ids
        if len(columns[0]):
            yield from _stripes(self.lang, columns, hot, words.cast(pa.string())).to_batches()

    def _windows(self, ids: np.ndarray, starts: int, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of the words of each window that counts; and whether its prefix is hot."""
        if self.m == 1:
            own = ids[ids > 0]
            return [own], np.ones(len(own), bool)
        hashes, k = _word_hashes(words), self.m - 1
        found, hot = [[np.empty(0, np.int32)] for _ in range(self.m)], [np.empty(0, bool)]
        for lo in range(0, starts, BLOCK):
            size = min(BLOCK, starts - lo) + 1  # phrases of k words: one from each start, and the end of the last window
            whole = np.ones(size, bool)
            for j in range(k):
                whole &= ids[lo + j : lo + j + size] > 0
            at = np.flatnonzero(whole)
            phrase = _Sieve.fold(self.lang, [hashes[ids[lo + at + j]] for j in range(k)])
            passes = self.sieve.has(phrase)
            whole[at] = passes
            counts = passes & np.append(whole[1:], False)[at]
            for j in range(self.m):
                found[j].append(ids[lo + at[counts] + j])
            hot.append(np.isin(phrase[counts], self.sieve.hot))
        return [np.concatenate(f) for f in found], np.concatenate(hot)


def _packed(columns: list[np.ndarray], bits: list[int]) -> np.ndarray:
    key = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key <<= np.uint64(b)
        key |= c.astype(np.uint64)
    return key


def _unpacked(key: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    out = []
    for b in reversed(bits):
        out.append((key & np.uint64((1 << b) - 1)).astype(np.int64))
        key = key >> np.uint64(b)
    return out[::-1]


def _distinct(columns: list[np.ndarray], bits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns``, whose values have ``bits`` bits, in order, and how often each comes."""
    if sum(bits) > 64:  # too wide for one key: the first two columns and the others become their ranks
        cuts = slice(0, 2), slice(2, None)
        halves = [np.unique(_packed(columns[c], bits[c]), return_inverse=True) for c in cuts]
        ranks, n = _distinct([r for _, r in halves], [32, 32])
        return [x for c, (known, _), r in zip(cuts, halves, ranks, strict=True) for x in _unpacked(known[r], bits[c])], n
    key = _packed(columns, bits)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return _unpacked(key[first], bits), np.diff(np.append(first, len(key)))


def _stripes(lang: str, columns: list[np.ndarray], hot: np.ndarray, words: pa.Array) -> pa.Table:
    """Counts equal windows and lays those of one prefix, of a hot one those of one slice, into one row."""
    columns, n = _distinct([*columns, hot], [max(1, (len(words) - 1).bit_length())] * len(columns) + [1])
    prefix, nxt, hot = columns[:-2], columns[-2], columns[-1] > 0  # in order of prefix, then next word
    new = np.zeros(len(n), bool)
    new[0] = True
    for p in prefix:
        new[1:] |= p[1:] != p[:-1]
    part = np.zeros(len(n), np.int32)
    if hot.any():
        # a slice must be the same in every task: it goes by the word, not by its id here
        used, inverse = np.unique(nxt[hot], return_inverse=True)
        part[hot] = np.asarray([sum(w) % SLICES for w in words.take(pa.array(used)).cast(pa.binary()).to_pylist()])[inverse]
        order = np.argsort((np.cumsum(new) - 1) * SLICES + part, kind="stable")
        prefix, nxt, part, n = [p[order] for p in prefix], nxt[order], part[order], n[order]
        new[1:] |= part[1:] != part[:-1]
    at = np.append(np.flatnonzero(new), len(n))
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1)
        rows, entries = at[lo:hi], slice(at[lo], at[hi])
        text = pc.binary_join_element_wise(*(words.take(pa.array(p[rows])) for p in prefix), " ") if prefix else pa.repeat("", hi - lo)
        counters = pa.StructArray.from_arrays([words.take(pa.array(nxt[entries])), pa.array(n[entries], pa.int64())], names=["next", "n"])
        stripe = pa.ListArray.from_arrays(pa.array(at[lo : hi + 1] - at[lo], pa.int32()), counters)
        out.append(pa.RecordBatch.from_arrays([pa.repeat(lang, hi - lo), text, pa.array(part[rows]), stripe], names=["lang", "prefix", "slice", "stripe"]))
        lo = hi
    return pa.Table.from_batches(out)


def tokens(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of ``text``, and for each of its words in turn 1 + the word's place among those; 0 where one
    or more pieces end."""
    raw = np.frombuffer(text.lower().translate(_TABLE), np.uint8)  # bytes: A-Z only
    end = raw == _END[0]
    inside = ~(end | (raw == 32))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return pa.array([], pa.binary()), np.zeros(int(end.any()), np.int32)
    offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
    told = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    ends = np.flatnonzero(end)
    ended = np.diff(np.concatenate([[0], np.searchsorted(ends, first), [len(ends)]])) > 0  # before each word, and after the last
    out = np.zeros(len(first) + np.count_nonzero(ended), np.int32)
    out[np.arange(len(first)) + np.cumsum(ended[:-1])] = told.indices.to_numpy(zero_copy_only=False) + 1
    return told.dictionary, out


def _parts(texts: list[bytes]):
    """The texts, each ended, in parts of about PART_BYTES; a long text is cut between words."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > PART_BYTES:
            end = at + PART_BYTES
            while end < len(text) and text[end] != 32 and text[end] not in _SEPARATORS:
                end += 1
            yield b"".join([*held, text[at:end]])
            held, size, at = [], 0, end
        held += [text[at:], _END]
        size += len(text) - at + 1
        if size >= PART_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _count(m: int, told):
    """``told``: the broadcast sieve, or None."""

    def run(batches):
        sieve = told.value if told else None
        held: dict[str, _Counter] = {}
        for b in slices(batches):
            langs, texts = b.column("lang"), b.column("text").cast(pa.binary())
            for lang in langs.unique().to_pylist():
                own = held.setdefault(lang, _Counter(lang, m, sieve))
                for part in _parts(texts.filter(pc.equal(langs, lang)).to_pylist()):
                    own.read(*tokens(part))
                    if own.size >= WINDOWS:
                        yield from own.ship(last=False)
            if sum(c.size for c in held.values()) >= 2 * WINDOWS:  # many languages: their sum is what fills memory
                for c in held.values():
                    yield from c.ship(last=True)
                held.clear()
        for c in held.values():
            yield from c.ship(last=True)

    return run


def _shipped(m: int, told):
    """The stripes of ``_count`` as they are shipped: a stripe's next words in one string, since no word holds a space, and
    their counts in an array. In shuffle files a struct for each counter takes about twice the room."""

    def run(batches):
        for b in _count(m, told)(batches):
            stripe = b.column("stripe")
            each = lambda field: pa.ListArray.from_arrays(stripe.offsets, stripe.values.field(field))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pc.binary_join(each("next"), " "), each("n").cast(pa.list_(pa.int32()))], names=["lang", "prefix", "slice", "next", "n"]
            )

    return run


def stripes(docs: DataFrame, m: int, sieve: _Sieve | None, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, prefix of m - 1 words, slice; frequent, that slice's counters (next, n) of ``least`` or more. Without a prefix
    (m = 1) also n, the sum of all its counters; else right, its largest, and only slices with a frequent counter."""
    told = docs.sparkSession.sparkContext.broadcast(sieve) if sieve else None
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shipped = given.mapInArrow(_shipped(m, told), SHIPPED)
    counters = F.arrays_zip(F.split("next", " ").alias("next"), F.col("n"))
    met = shipped.repartition("lang", "prefix", "slice").select("lang", "prefix", "slice", F.inline(counters))
    # elementwise: the stripes of a prefix lie together, so this sum needs no second shuffle
    merged = met.groupBy("lang", "prefix", "slice", "next").agg(F.sum("n").alias("n"))
    often, entry = F.col("n") >= least, F.struct("next", "n")
    if m == 1:
        return merged.groupBy("lang", "prefix", "slice").agg(F.sum("n").alias("n"), F.collect_list(F.when(often, entry)).alias("frequent"))
    return merged.where(often).groupBy("lang", "prefix", "slice").agg(F.max("n").alias("right"), F.collect_list(entry).alias("frequent"))


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m words, a occurrences, right: occurrences of its commonest extension, null if fewer than ``least``)
    of every phrase of up to four words that occurs ``least`` times, and (lang, n words)."""
    sieve, total, found = None, None, []
    for m in range(1, MOST_WORDS + 1):
        level = stage(stripes(docs, m, sieve, text_col=text_col, lang_col=lang_col, least=least))
        own = level.select("lang", "prefix", F.inline("frequent")).select(
            "lang", F.when(F.lit(m == 1), F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), F.lit(m).alias("m"), F.col("n").alias("a")
        )
        if m == 1:
            total = stage(level.groupBy("lang").agg(F.sum("n").alias("n")))
            hot_from = max(HOT_LEAST, (total.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE)
        else:
            right = level.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("right").alias("right"))
            found[-1] = found[-1].join(right, ["lang", "phrase"], "left")
        found.append(own)
        if m < MOST_WORDS:
            sieve = _sieve(own, m, hot_from)
    found[-1] = found[-1].withColumn("right", F.lit(None).cast("long"))
    frequent = found[0]
    for f in found[1:]:
        frequent = frequent.unionByName(f)
    return stage(frequent), total


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    known, total = phrases(docs, text_col=text_col, lang_col=lang_col, least=least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # left extensions: a phrase without its first word has that phrase as an extension
    left = known.where("m > 2").groupBy("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")).agg(F.max("a").alias("left"))
    longer = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))).cast("decimal(20,0)")
    kept = known.where("m > 1").join(left, ["lang", "phrase"], "left").where(~(longer * 100 >= wide("a") * subsumed))
    cuts = stage(
        kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
            "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))").alias("rest")
        )
    )
    part = known.select("lang", "phrase", "a")
    told = stage(join_hot(cuts, part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]))
    told = join_hot(told, part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    scored = told.select("lang", "phrase", "a", "k", "l", "r", F.expr(f"cast((cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)").alias("score"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = worst.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, w[i:i + m - 1] AS g FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, array_to_string(g[i:i + k - 1], ' ') AS phrase, max(a) AS most
  FROM f, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i) WHERE m > k AND i + k - 1 <= m GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.m, f.g, f.a FROM f LEFT JOIN x USING (lang, phrase) WHERE f.m > 1 AND NOT coalesce(100 * x.most >= 80 * f.a, false)),
u AS (SELECT lang, phrase, a, k, array_to_string(g[1:k], ' ') AS first, array_to_string(g[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
k AS (SELECT u.lang, u.phrase, u.a, k, l.a AS l, r.a AS r, (2000000 * u.a::HUGEINT // (l.a + r.a))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.first JOIN f r ON r.lang = u.lang AND r.phrase = u.rest),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n USING (lang) WHERE t.rank <= 2000
"""
