"""Exact top-k search by integer inner product, with block-at-a-time pruning.

Terms are the vectors' dimensions. Distinct vectors are laid in an order that puts like ones together and cut into
blocks, document ranges of that order; a block keeps its forward index (its matrix) and, for each term, the largest and
smallest weight. For a query the blocks are ordered by the sum of term maxima (weight times the block's largest or
smallest component, by its sign), and scored in that order until the next bound falls below the query's k-th score.

Equal vectors are one entry with its k + 1 smallest distinct ids, each as often as it is repeated but k times at most:
without a query's own id, k or more remain, which is all that can reach a top k when ties go to smaller ids. Queries meet the index in a grid of query groups and index shards of bounded size; each cell returns its k best of
each query, a last step the k best of all. A floor for the k-th score comes from the query's own block.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
shorter vectors count as zero-padded; repeated ids are entries of their own, but a query never meets its own id; fewer
than k candidates give all; an empty table gives an empty result; other columns are ignored. Scores are exact while
they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stage

SCALE, TOP, BLOCK = 64, 20, 128
#: Distinct vectors of an index shard and queries of a group: what one cell of the grid holds.
SHARD_ROWS, GROUP_ROWS = 32_768, 4_096
_EXACT = 2.0**53


def quantized(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q, floor(SCALE * x) of every component, of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(SCALE * x.cast("double"))).alias("q"))


def _matrix(lists: list, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, lists)], default=0)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T``: in double precision where every partial sum is exact there, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < _EXACT else a @ b.T


def _order_key(q: np.ndarray) -> np.ndarray:
    """Locality key of each vector: signs of fixed random projections, most significant first."""
    planes = np.random.default_rng(5).standard_normal((16, 4096))[:, : q.shape[1]]
    if q.shape[1] > planes.shape[1]:
        planes = np.random.default_rng(5).standard_normal((16, q.shape[1]))
    centred = q + 0.5  # floor() moves every component down by a half on average
    signs = (centred.astype(float) @ planes.T > 0).astype(np.int64)
    return signs @ (1 << np.arange(15, -1, -1))


def _keyed(batches):
    for b in slices(batches, 5_000):
        q = _matrix(b.column("q").to_pylist())
        key = _order_key(q) if len(q) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.int64())], names=[*b.schema.names, "_key"])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class _Shard:
    """Blocks of one shard: forward indexes, the bounds of their terms, the ids of their entries."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        self.vectors, self.ids = vectors, ids
        self.first = list(range(0, len(vectors), BLOCK))
        blocks = [vectors[i : i + BLOCK] for i in self.first]
        self.high, self.low = (np.stack([f(b, axis=0) for b in blocks]) for f in (np.max, np.min))
        self.least_id = np.asarray([min(min(x) for x in ids[i : i + BLOCK]) for i in self.first])

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int):
        """Per query (scores, ids) of its k best here; entries below the query's floor may be left out."""
        bounds = _products(np.maximum(queries, 0), self.high) + _products(np.minimum(queries, 0), self.low)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        kth, kth_id = floors.copy(), np.full(len(queries), np.iinfo(np.int64).max)
        active = np.arange(len(queries))
        for r in range(len(self.first)):
            block = turn[active, r]
            bound = bounds[active, block]
            going = bound >= kth[active]  # bounds only fall from here on
            active, block, bound = active[going], block[going], bound[going]
            if not len(active):
                break
            # at a tie the block matters only if it may hold a smaller id
            use = (bound > kth[active]) | (self.least_id[block] < kth_id[active])
            rows, block = active[use], block[use]
            order = np.argsort(block, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if not len(some):
                    continue
                at = self.first[block[some[0]]]
                ids = self.ids[at : at + BLOCK]
                n_ids = np.asarray([len(x) for x in ids])
                flat = np.asarray([i for x in ids for i in x], np.int64)
                scores = np.repeat(_products(queries[rows[some]], self.vectors[at : at + BLOCK]), n_ids, axis=1)
                for j, q in enumerate(rows[some].tolist()):
                    near = (scores[j] >= kth[q]) & (flat != own[q])
                    if near.any():
                        s, i = found[q]
                        s, i = _best(np.concatenate([s, scores[j][near]]), np.concatenate([i, flat[near]]), k)
                        found[q] = (s, i)
                        if len(s) == k:
                            kth[q], kth_id[q] = s[-1], i[-1]
        return found


def _floor(shard: _Shard, at: int, query: np.ndarray, own: int, k: int) -> int:
    """The query's k-th score within its own block, a floor for its k-th score overall."""
    i = at // BLOCK * BLOCK
    scores = np.repeat(_products(query[None, :], shard.vectors[i : i + BLOCK])[0], [len(set(x) - {own}) for x in shard.ids[i : i + BLOCK]])
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else np.iinfo(np.int64).min


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, is_query: str = "vec_id % 20 = 0") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col=id_col, vector_col=vector_col)
    # salting the ids first keeps a vector with very many copies from gathering them in one task
    times = rows.groupBy("q", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    part = times.groupBy("q", F.expr("pmod(xxhash64(vec_id), 64)").alias("_salt")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    part = part.select("q", "_salt", F.slice("ids", 1, k + 1).alias("ids"))
    entries = part.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = entries.select("q", F.flatten(F.transform("ids", lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"))
    keyed = stage(entries.mapInArrow(_keyed, "q array<long>, ids array<long>, _key long"))
    n = keyed.count()
    shards = max(1, -(-n // SHARD_ROWS))
    # shards are ranges of the locality order
    index = stage(keyed.repartitionByRange(shards, "_key", F.xxhash64("q")).sortWithinPartitions("_key").withColumn("_shard", F.spark_partition_id()))
    shards = (index.agg(F.max("_shard")).first()[0] or 0) + 1  # as dealt: the session may have asked for more
    queries = stage(rows.where(is_query).select("vec_id", "q").dropDuplicates())
    groups = max(1, -(-queries.count() // GROUP_ROWS))
    grouped = queries.withColumn("_group", F.expr(f"cast(pmod(xxhash64(vec_id), {groups}) as int)"))
    side_a = index.select("_shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(0).alias("_kind"), "_key", "q", "ids")
    side_b = grouped.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), "_group", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_key"), "q", F.array("vec_id").alias("ids")
    )

    def cell(table: pa.Table) -> pa.Table:
        kind = table.column("_kind").to_numpy()
        q = _matrix(table.column("q").to_pylist())
        ids = table.column("ids").to_pylist()
        docs, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out = ([], [], [])
        if len(docs) and len(asks):
            docs = docs[np.lexsort((*q[docs].T[:4], table.column("_key").to_numpy()[docs]))]
            shard = _Shard(q[docs], [ids[i] for i in docs])
            own = np.asarray([ids[i][0] for i in asks], np.int64)
            place = {x.tobytes(): i for i, x in enumerate(shard.vectors)}
            least = np.iinfo(np.int64).min
            floors = np.asarray([_floor(shard, place[v.tobytes()], v, o, k) if v.tobytes() in place else least for v, o in zip(q[asks], own, strict=True)], np.int64)
            for o, (s, i) in zip(own.tolist(), shard.search(q[asks], own, floors, k), strict=True):
                out[0].append(np.full(len(s), o))
                out[1].append(i)
                out[2].append(s)
        cols = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    found = side_a.unionByName(side_b).groupBy("_shard", "_group").applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
