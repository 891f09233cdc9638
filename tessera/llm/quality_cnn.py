"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are read in overlapping chunks that cover it whole. In a chunk, learned filters slide over the
bytes; each filter's largest value is kept (max-pooling). A chunk's logit is linear in those maxima and its length; the
document's logit combines the mean over its chunks with the largest and the smallest, and gives one probability.

A filter is a table of WIDTH x 256 weights, so a filter's value at a place is a sum of table entries, and the gradient
reaches just the entries under the maximum. Fitted on the driver, by Adam, from a bounded sample of labelled rows
(``TRAIN_ROWS``, ``TRAIN_CHARS``, ``TRAIN_CHUNKS`` chunks a document); labels of the held-out fold are never read.

Defined results: a null or empty text is one chunk of padding; long texts are read whole; repeated rows get equal
scores; without any labelled row the score is a half; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, slices

TRAIN_ROWS, TRAIN_CHARS, TRAIN_CHUNKS = 2_400, 20_000, 3
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
CUT = 0.3
CHUNK, OVERLAP, WIDTH, FILTERS, STRIDE = 384, 64, 6, 16, 2
EPOCHS, BATCH, RATE = 8, 96, 0.02
_STEP = CHUNK - OVERLAP
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    table: np.ndarray  # WIDTH, 256, FILTERS
    out: np.ndarray  # of a chunk's logit: FILTERS maxima, log length, bias
    mix: np.ndarray  # of the document's logit: mean, largest, smallest chunk logit, bias


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as rows of bytes, padded with zeros; their lengths). Each starts OVERLAP bytes before the last one ends."""
    n = max(1, -(-(len(data) - OVERLAP) // _STEP))
    whole = np.zeros((n - 1) * _STEP + CHUNK, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::_STEP]
    return rows, np.minimum(len(data) - np.arange(n) * _STEP, CHUNK)


def initial(rng: np.random.Generator) -> Network:
    """Random filters over kinds of bytes (letter cases, vowels, blanks, digits, signs, bytes beyond ASCII)."""
    b = np.arange(256)
    char = np.asarray([chr(i) for i in range(256)])
    kinds = np.stack(
        [np.char.isalpha(char) & (b < 128), np.char.isupper(char) & (b < 128), np.isin(char, list("aeiouAEIOU")), b == 32, (b >= 48) & (b < 58), (b > 32) & (b < 128) & ~np.char.isalnum(char), b >= 128, b == 0], 1
    ).astype(float)
    own = rng.normal(0, 0.5, (256, 8))
    features = np.hstack([kinds * 2, own])
    table = np.einsum("bk,wkf->wbf", features, rng.normal(0, 0.3, (WIDTH, features.shape[1], FILTERS)))
    return Network(table.astype(np.float32), np.concatenate([rng.normal(0, 0.1, FILTERS), [0.0, 0.0]]), np.asarray([1.0, 0.0, 0.0, 0.0]))


def _pairs(table: np.ndarray) -> np.ndarray:
    """Tables of two neighbouring bytes: half as many look-ups a place."""
    return np.stack([(table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])


def maxima(rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest value of each filter in each chunk, its place)."""
    two = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
    values = pairs[0][two[:, : _PLACES * STRIDE : STRIDE]]
    for j in range(1, WIDTH // 2):
        values += pairs[j][two[:, 2 * j : 2 * j + _PLACES * STRIDE : STRIDE]]
    at = values.argmax(axis=1)
    return np.take_along_axis(values, at[:, None, :], axis=1)[:, 0, :], at


def _inputs(peaks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.hstack([peaks, np.log1p(lengths)[:, None] / 6, np.ones((len(peaks), 1))])


def _adam(param, grad, state, t):
    m, v = state
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    param -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Network | None:
    """Filters and chunk weights on chunks that share their document's label, then the mix of chunks on documents."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    net = initial(rng)
    rows, lengths, y = [], [], []
    for text, label in zip(texts, labels, strict=True):
        r, n = chunks(text.encode())
        some = rng.permutation(len(r))[:TRAIN_CHUNKS]
        rows.append(r[some])
        lengths.append(n[some])
        y += [label] * len(some)
    rows, lengths, y = np.concatenate(rows), np.concatenate(lengths), np.asarray(y, float)
    share = np.clip(y.mean(), 0.02, 0.98)
    net.out[-1] = np.log(share / (1 - share))
    states = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.table, net.out)]
    t = 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            t += 1
            peaks, at = maxima(rows[some], _pairs(net.table))
            x = _inputs(peaks, lengths[some])
            p = 1 / (1 + np.exp(-np.clip(x @ net.out, -30, 30)))
            err = (p - y[some]) / len(some)
            grad = np.zeros_like(net.table)
            own = rows[some]
            push = (err[:, None] * net.out[:FILTERS]).astype(np.float32)
            for j in range(WIDTH):
                under = np.take_along_axis(own, at * STRIDE + j, axis=1)
                np.add.at(grad[j], (under, np.arange(FILTERS)[None, :]), push)
            _adam(net.out, x.T @ err + 1e-4 * net.out, states[1], t)
            _adam(net.table, grad + 1e-5 * net.table, states[0], t)
    pairs = _pairs(net.table)
    z = np.stack([_pooled(_chunk_logits(net, pairs, t.encode())) for t in texts])
    net.mix = _logistic(z, np.asarray(labels, float))
    return net


def _chunk_logits(net: Network, pairs: np.ndarray, data: bytes) -> np.ndarray:
    rows, lengths = chunks(data)
    return np.concatenate([_inputs(maxima(rows[i : i + 256], pairs)[0], lengths[i : i + 256]) @ net.out for i in range(0, len(rows), 256)])


def _pooled(logits: np.ndarray) -> np.ndarray:
    return np.asarray([logits.mean(), logits.max(), logits.min(), 1.0])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, prior = np.asarray([1.0, 0.0, 0.0, 0.0]), np.asarray([1.0, 0.0, 0.0, 0.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + (w - prior))
    return w


def probabilities(net: Network | None, texts: list[str | None], pairs: np.ndarray | None = None) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    pairs = _pairs(net.table) if pairs is None else pairs
    z = np.asarray([_pooled(_chunk_logits(net, pairs, (t or "").encode())) @ net.mix for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    texts, y = labelled_sample(docs, labels, "quality", f"not ({HELD_OUT})", TRAIN_ROWS, TRAIN_CHARS)
    net = fit(texts, y)

    def run(batches):
        pairs = None if net is None else _pairs(net.table)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(probabilities(net, b.column("text").to_pylist(), pairs), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
