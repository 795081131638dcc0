"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities.

Every term owns a sparse ternary index vector. A term's vector is the sum of the index vectors of its neighbours over the whole corpus, plus its own;
sums are whole numbers, so the result doesn't depend on the order of the rows or the number of tasks. Terms are hashed into a fixed number of buckets, so what is
sent to the driver has a fixed size, whatever the corpus. A word of letters in usual case stands for itself; any other word (marks, digits, shouting) stands for its shape.
A run of more than LONGEST characters without white space is cut into parts of letters, digits or marks, and these into pieces about as long as a word, which all count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, NONZERO = 1 << 13, 48, 2
MOST_LABELLED = 20_000
HIDDEN = 32
LONGEST, PIECE = 64, 4
THRESHOLD = 0.3
_USUAL = re.compile(r"[^\W\d_]?[^\W\d_A-Z]*[.,]?\Z")
_PARTS = re.compile(r"[^\W\d_]+|\d+|[\W_]+")


def term(word: str) -> int:
    """The bucket of a word."""
    if _USUAL.match(word) and (len(word) < 2 or not word.isupper()):
        return zlib.crc32(word.lower().rstrip(".,").encode()) % (BUCKETS - 1024)
    shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
    return BUCKETS - 1024 + zlib.crc32(shape.encode()) % 1024


def split(text: str | None) -> list[str]:
    """The words of a text, long runs in pieces; no character is left out."""
    ws = text.split() if text else []
    if not ws or max(map(len, ws)) <= LONGEST:
        return ws
    out = []
    for w in ws:
        if len(w) > LONGEST:
            out.extend(part[i : i + PIECE] for part in _PARTS.findall(w) for i in range(0, len(part), PIECE))
        else:
            out.append(w)
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector."""
    rng = np.random.default_rng(77)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int32)
    return places, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO))


def _terms(texts: list[str | None], memo: common.Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one document after the other, and the documents' lengths."""
    memo.trim()
    parts = []
    for text in texts:
        ws = split(text)
        parts.append(np.fromiter(map(memo.__getitem__, ws), np.int32, len(ws)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64)


def count_contexts(docs: DataFrame, text_col: str = "text", blocks: int = 16) -> np.ndarray:
    """Sums of neighbours' index vectors, BUCKETS x DIM, over all documents. Each task adds up its own; the sums meet by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM, np.int64)
        memo, some = common.Memo(term), False
        for batch in common.pieces(batches, "_text", 8 << 20):
            t, lengths = _terms(batch.column(0).to_pylist(), memo)
            if len(t) < 2:
                continue
            some = True
            same = np.ones(len(t) - 1, bool)
            ends = np.cumsum(lengths)[:-1]
            same[ends[(ends > 0) & (ends < len(t))] - 1] = False
            left, right = t[:-1][same].astype(np.int64), t[1:][same].astype(np.int64)
            for k in range(NONZERO):
                for own, near in ((left, right), (right, left)):
                    total += np.bincount(own * DIM + places[near, k], weights=signs[near, k], minlength=BUCKETS * DIM).astype(np.int64)
        if some:
            for b, part in enumerate(total.reshape(blocks, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def add(key, frame):
        import pandas as pd

        return pd.DataFrame({"block": [key[0]], "sums": [sum(np.frombuffer(x, np.int64) for x in frame.sums).tobytes()]})

    parts = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "block int, sums binary")
    # Two steps, so that no task adds up more than a fixed number of partial sums however many tasks there were.
    some = parts.withColumn("deal", F.spark_partition_id() % 64).groupBy("block", "deal").applyInPandas(add, "block int, sums binary")
    out = np.zeros((blocks, BUCKETS * DIM // blocks), np.int64)
    for row in some.groupBy("block").applyInPandas(add, "block int, sums binary").collect():
        out[row.block] = np.frombuffer(row.sums, np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.put_along_axis(own, places, signs.astype(float) / np.sqrt(NONZERO), axis=1)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (own + sums / np.maximum(norm, 1)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, memo: common.Memo) -> np.ndarray:
    """Mean word vector of each text, and the logarithm of its word count; all zero for a text without words."""
    t, lengths = _terms(texts, memo)
    out = np.zeros((len(lengths), DIM + 1), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
        first = 0
        while first < len(full):  # about 200,000 words at a time
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + 200_000)))
            end = starts[last] if last < len(full) else len(t)
            out[full[first:last], :DIM] = np.add.reduceat(vectors[t[starts[first] : end]], starts[first:last] - starts[first], axis=0)
            first = last
        out[full, :DIM] /= lengths[full, None]
        out[:, DIM] = np.log1p(lengths) / 10
    return out


@dataclass
class Network:
    """Two layers and a temperature; ``mean`` and ``scale`` standardise the input."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return common.sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on four fifths of the rows; the temperature is the one of least log loss on the rest. Without rows of both labels it predicts their mean."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    net = Network(vectors, mean, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, fit = order[:cut], order[cut:]
    net.w2 = rng.normal(0, 0.1, hidden)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for epoch in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 256):
            i = fit[at : at + 256]
            h = np.tanh(z[i] @ params[0] + params[1])
            g = (common.sigmoid(h @ params[2] + params[3][0]) - y[i]) / len(i)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * params[0], back.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for p, q, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (q - a)
                b += 0.001 * (q * q - b)
                p -= 3e-3 * (1 - epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    raw = net.logits(x[held])
    loss = lambda t: -np.mean(np.log(np.clip(np.where(y[held] == 1, common.sigmoid(raw / t), 1 - common.sigmoid(raw / t)), 1e-12, 1)))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", mod: int = 5, held: int = 0, most: int = MOST_LABELLED) -> Network:
    """Word vectors from all documents, the network from at most about ``most`` labelled ones outside the held-out split."""
    vectors = word_vectors(count_contexts(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # a fixed size: BUCKETS x DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.Memo(term)
        for batch in common.pieces(batches, "_text", 8 << 20):
            x = pool(batch.column(0).to_pylist(), shared.value, memo)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "y"])

    rows = common.labelled(docs, labels, label, mod, held, most, id_col, text_col).mapInArrow(run, "x binary, y int").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(-1, DIM + 1)
    y = np.array([r.y for r in rows], np.float64)
    order = np.lexsort((y, *x.T[:4]))  # the order in which tasks end must not matter
    return train(x[order], y[order], vectors)


def _probability(docs: DataFrame, model: Network):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def probability():
        net, memo = shared.value, common.Memo(term)
        return lambda texts: net.probability(pool(texts, net.vectors, memo))

    return probability


def score(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, mod: int = 5, held: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text, however long: id, held_out, score, predicted, and the columns named in ``keep``, but for those named like a result.

    A null or empty text is pooled to zeros and scored like others. A null id is never held out. Repeated rows give repeated results; an empty table gives an empty table.
    """
    return common.scored(docs, _probability(docs, model), id_col, text_col, mod, held, threshold, keep)


def good(docs: DataFrame, model: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that score the threshold or more, with all their columns, whatever the names. Nulls and empty texts are scored like others; repeated rows stay or go together."""
    return common.passing(docs, _probability(docs, model), text_col, lambda p: p >= threshold)
