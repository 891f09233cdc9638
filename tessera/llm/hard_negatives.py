"""Hard negatives by threshold joins over a norm-bounded inverted index.

A threshold join finds all rows whose integer inner product with an anchor reaches the anchor's threshold. Dimensions
are taken in order of falling energy. A shard's index holds, for each group of dimensions, the rows posted there: a row
leaves out the last groups once the norm of what is left of it, times the largest norm left of an anchor, stays below
the smallest threshold. Partial scores are accumulated group by group; a pair is given up when its partial score plus
the product of the two remaining norms falls below the threshold; what is left is verified exactly.

Positives: the k-th best same-label score within a bounded sample is a threshold that loses none of an anchor's k best.
Negatives: each positive opens a window of scores. The thresholds start near the windows' upper ends and are lowered,
over ROUNDS, until each window is full or its lower end is reached; full windows leave the next round.

Rows lie in shards of bounded size in order of label; they are shuffled once a join and anchors are copied, only to
shards that can hold an answer: for positives those with the anchor's label, for negatives those with another label and
a large enough norm. A task holds one shard and streams anchors past it.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; shorter
vectors count as zero-padded; rows repeated whole count once; other rows of an anchor's own id are never its positives,
but may be negatives if their label differs; ties go to the smaller id; a positive of negative score has an empty window;
an anchor without positives, or a window without rows, returns nothing; an empty table gives an empty result; other
columns are ignored. Scores are exact while they, times 95, fit a long. To the driver go 24 bytes for each SHARD_ROWS
rows and the sample of SAMPLE_CELLS components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stage
from tessera.llm.joins import join_hot

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Share of a window, from its upper end, that each round's thresholds have come down to.
ROUNDS = (1 / 8, 1 / 2, 1)
#: Rows of a shard and of a block within it, anchors that meet a block at once, components of the sample.
SHARD_ROWS, BLOCK, ASKS, SAMPLE_CELLS = 32_768, 4_096, 256, 262_144
#: Cuts of the dimensions, in order of energy, into groups.
CUTS = (0, 1 / 4, 1 / 2, 1)
_EXACT = 2.0**53
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantized(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and q, floor(SCALE * x) of every component, of the rows that take part; each once."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    q = F.transform(v, lambda x: F.floor(SCALE * x.cast("double")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q")).dropDuplicates()


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero-padded to ``width``, from its flat values."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tails(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of what is left of each row from each cut on, rounded up."""
    left = np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    left = np.concatenate([left, np.zeros((len(x), 1))], axis=1)
    return np.sqrt(left[:, cuts]) * (1 + 1e-9)


class ShardIndex:
    """The index of one shard; ``order``: dimensions by falling energy."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray):
        self.ids, self.labels, self.order = ids, labels, order
        self.vectors = vectors[:, order]
        self.cuts = sorted({round(c * len(order)) for c in CUTS})
        self.tails = _tails(self.vectors, self.cuts)
        self.largest = float(np.abs(vectors).max(initial=0))

    def matches(self, asks: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, same: bool):
        """(ask, row, score) of all pairs of equal, or else different, label that reach the ask's ``low``; by blocks of
        rows. ``own``: ids that are left out, if ``same``."""
        asks = asks[:, self.order]
        tails, groups = _tails(asks, self.cuts), len(self.cuts) - 1
        goal = low.astype(float) - np.abs(low.astype(float)) * 1e-9
        floats = asks.astype(float)
        plain = float(np.abs(asks).max(initial=0)) * self.largest * max(1, asks.shape[1]) < _EXACT
        for at in range(0, len(self.ids), BLOCK):
            rows = np.arange(at, min(at + BLOCK, len(self.ids)))
            # the first group from which a row is left out of the index
            posted = (self.tails[rows] * tails.max(axis=0) >= goal.min()).sum(axis=1).clip(max=groups) if goal.min() > 0 else np.full(len(rows), groups)
            turn = np.argsort(-posted, kind="stable")
            rows, posted = rows[turn], posted[turn]
            partial = np.zeros((len(asks), len(rows)))
            for g in range(groups):
                n = int((posted > g).sum())  # the posting list of this group: the first n rows
                part = slice(self.cuts[g], self.cuts[g + 1])
                partial[:, :n] += floats[:, part] @ self.vectors[rows[:n], part].T.astype(float)
                done = np.minimum(posted, g + 1)
                bound = partial + tails[:, done] * self.tails[rows, done]
                alive = (bound >= goal[:, None]).any(axis=0)
                if not alive.all():
                    rows, posted, partial, bound = rows[alive], posted[alive], partial[:, alive], bound[:, alive]
                if not len(rows):
                    break
            if not len(rows):
                continue
            fits = labels[:, None] == self.labels[rows]
            fits = fits & (own[:, None] != self.ids[rows]) if same else ~fits
            a, r = np.nonzero((bound >= goal[:, None]) & fits)
            whole = plain and posted[r].min(initial=groups) == groups
            for i in range(0, len(a), 65_536):
                x, y = a[i : i + 65_536], rows[r[i : i + 65_536]]
                score = partial[x, r[i : i + 65_536]].astype(np.int64) if whole else np.einsum("ij,ij->i", asks[x], self.vectors[y])
                hit = score >= low[x]
                yield x[hit], y[hit], score[hit]


def _firsts(key: np.ndarray, score: np.ndarray, ids: np.ndarray, want: int) -> np.ndarray:
    """Places of the ``want`` best of each key, best first."""
    order = np.lexsort((ids, -score, key))
    k = key[order]
    start = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1] if len(k) else np.empty(0, np.int64)
    nth = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
    return order[nth < want]


def _answer(index: ShardIndex, table: pa.RecordBatch, width: int, same: bool, want: int) -> pa.RecordBatch:
    """The ``want`` best rows of this shard for each window of each ask."""
    windows = table.column("windows")
    n = pc.list_value_length(windows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = windows.flatten()
    low, high, name = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high", "w"))
    ask_of = np.repeat(np.arange(len(n)), n)
    first, most = np.cumsum(n) - n, int(n.max(initial=0))
    floor = np.minimum.reduceat(low, first) if len(first) else np.empty(0, np.int64)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    labels, own = table.column("label").to_numpy(), table.column("vec_id").to_numpy()
    for a, r, s in index.matches(dense(table.column("q"), width), labels, own, floor, same):
        keys, places = [best[0]], [np.arange(len(best[0]))]
        for k in range(most):
            w = first[a] + k
            ok = k < n[a]
            ok[ok] = (s[ok] >= low[w[ok]]) & (s[ok] <= high[w[ok]])
            keys.append(w[ok])
            places.append(np.flatnonzero(ok))
        ids, score = (np.concatenate([b, *[x[p] for p in places[1:]]]) for b, x in ((best[1], index.ids[r]), (best[2], s)))
        key = np.concatenate(keys)
        top = _firsts(key, score, ids, want)
        best = (key[top], ids[top], score[top])
    aid = table.column("aid").to_numpy()[ask_of[best[0]]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (aid, name[best[0]], best[1], best[2])], names=["aid", "w", "vec_id", "score"])


def _tasks(width: int, order: np.ndarray, same: bool, want: int):
    def run(batches):
        shard, held, index = None, [], None
        for b in batches:
            at, kind = b.column("_shard").to_numpy(), b.column("_kind").to_numpy()
            edges = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1, len(at)] if len(at) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if at[i] != shard:
                    shard, held, index = at[i], [], None
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), dense(part.column("q"), width)))
                    continue
                if index is None:
                    index = ShardIndex(*(np.concatenate(x) for x in zip(*held, strict=True)), order)
                    held = []
                for some in slices([part], ASKS):
                    yield _answer(index, some, width, same, want)

    return run


class Rows:
    """All rows in shards of bounded size in order of label, with what is known of the shards."""

    def __init__(self, rows: DataFrame):
        norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm")
        self.given = stage(rows.select("vec_id", "label", "q", norm))
        told = self.given.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
        self.width, shards = told["width"], max(1, -(-told["n"] // SHARD_ROWS))
        dealt = self.given.repartitionByRange(shards, "label", F.xxhash64("vec_id", "q"))
        self.table = stage(dealt.withColumn("_shard", F.spark_partition_id()))
        self.labels = stage(self.table.groupBy("_shard", "label").agg(F.max("norm").alias("norm")))
        energy = self.table.mapInArrow(self._energy(self.width), "dim int, energy double").groupBy("dim").agg(F.sum("energy").alias("energy")).orderBy(F.desc("energy"), "dim")
        self.order = np.asarray([r["dim"] for r in energy.collect()] or range(self.width), np.int64)

    @staticmethod
    def _energy(width: int):
        def run(batches):
            total = np.zeros(width)
            for b in batches:
                total += (dense(b.column("q"), width).astype(float) ** 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["dim", "energy"])

        return run

    def join(self, asks: DataFrame, same: bool, want: int) -> DataFrame:
        """aid, w, vec_id and score of the ``want`` best rows, ties to smaller ids, in each of the ``windows`` (w, low,
        high) of each ask (aid, vec_id, label, q, norm, windows), of its label or else of other labels."""
        if same:
            where = self.labels.groupBy("label").agg(F.sort_array(F.collect_set("_shard")).alias("shards"))
            sent = join_hot(asks, where, ["label"]).withColumn("_shard", F.explode("shards"))
        else:
            shards = self.labels.groupBy("_shard").agg(F.max("norm").alias("norm"), F.min("label").alias("least"), F.max("label").alias("most"))
            shards = shards.agg(F.collect_list(F.struct("_shard", "norm", "least", "most")).alias("shards"))
            low = F.array_min(F.transform("windows", lambda w: w["low"]))
            can = F.filter("shards", lambda s: ((s["least"] != F.col("label")) | (s["most"] != F.col("label"))) & (s["norm"] * F.col("norm") * (1 + 1e-9) >= low))
            sent = asks.crossJoin(F.broadcast(shards)).withColumn("_shard", F.explode(F.transform(can, lambda s: s["_shard"])))
        sent = sent.select("_shard", F.lit(1).alias("_kind"), "aid", "vec_id", "label", "q", "windows", F.array_min(F.transform("windows", lambda w: w["low"])).alias("_low"))
        held = self.table.select("_shard", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("aid"), "vec_id", "label", "q", F.lit(None).cast("array<struct<w:bigint,low:bigint,high:bigint>>").alias("windows"), F.lit(0).cast("long").alias("_low"))
        met = held.unionByName(sent).repartition("_shard").sortWithinPartitions("_shard", "_kind", "_low")
        found = met.mapInArrow(_tasks(self.width, self.order, same, want), "aid long, w long, vec_id long, score long")
        rank = F.expr("row_number() over (partition by aid, w order by score desc, vec_id)")
        return found.withColumn("rank", rank).where(F.col("rank") <= want)


def _floors(asks: DataFrame, rows: Rows, k: int) -> DataFrame:
    """``asks`` with ``low``, a score that the k best of the same label reach, whatever the sample."""
    sample = rows.given.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(max(1, SAMPLE_CELLS // max(1, rows.width))).select("vec_id", "label", "q").toArrow()
    ids, labels = (sample.column(c).to_numpy() for c in ("vec_id", "label"))
    known = dense(sample.column("q").combine_chunks(), rows.width) if sample.num_rows else np.zeros((0, rows.width), np.int64)
    width = rows.width

    def run(batches):
        for b in slices(batches, 1_024):
            score = dense(b.column("q"), width) @ known.T
            score[(b.column("label").to_numpy()[:, None] != labels) | (b.column("vec_id").to_numpy()[:, None] == ids)] = _LEAST
            low = np.partition(score, score.shape[1] - k, axis=1)[:, -k] if score.shape[1] >= k else np.full(b.num_rows, _LEAST)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int64())], names=[*b.schema.names, "low"])

    return asks.mapInArrow(run, "aid long, vec_id long, label long, q array<long>, norm double, low long")


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor, a row for which
    ``is_anchor`` (SQL over vec_id, label and q) holds, and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels that score LOW_PERCENT to HIGH_PERCENT of the positive."""
    rows = Rows(quantized(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col))
    anchors = stage(rows.given.where(is_anchor).select(F.monotonically_increasing_id().alias("aid"), "vec_id", "label", "q", "norm"))
    window = lambda w, low, high: F.struct(w.cast("long").alias("w"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    asks = stage(_floors(anchors, rows, positives)).withColumn("windows", F.array(window(F.lit(0), F.col("low"), F.lit(int(_MOST))))).drop("low")
    near = stage(rows.join(asks, True, positives).select("aid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    spans = near.where("positive_score >= 0").select("aid", F.col("positive_score").alias("w")).distinct()
    spans = spans.select("aid", "w", F.expr(f"({LOW_PERCENT} * w + 99) div 100").alias("least"), F.expr(f"({HIGH_PERCENT} * w) div 100").alias("high")).where("least <= high")
    open_, done = stage(spans), []
    for share in ROUNDS:
        low = F.when(F.lit(share >= 1), F.col("least")).otherwise(F.greatest("least", F.col("high") - F.floor((F.col("high") - F.col("least")) * share)))
        wanted = open_.groupBy("aid").agg(F.collect_list(window(F.col("w"), low, F.col("high"))).alias("windows"))
        found = stage(rows.join(anchors.join(wanted, "aid"), False, negatives))
        if share >= 1:
            done.append(found)
            break
        full = found.groupBy("aid", "w").agg(F.count("*").alias("n")).where(f"n >= {negatives}").select("aid", "w")
        done.append(found.join(full, ["aid", "w"], "left_semi"))
        open_ = stage(open_.join(full, ["aid", "w"], "left_anti"))
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("aid", F.col("w").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    named = near.join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return named.join(out, ["aid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """``vectors`` where every seventh id has the next of ten labels."""
    return vectors.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)))


ORACLE = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
