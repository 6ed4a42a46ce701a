"""Quality classifier: logistic regression over hashed word n-grams, by FTRL-proximal.

Tokens are runs of letters and digits or of other signs; a token that equals one of the
two before it counts as a sign of its own, so that stuttering texts share features.
Features are the counts of uni- to trigrams in 2**BITS buckets, under the square root
and scaled to length 1; a score is a sparse dot product under the logistic function.

Training goes over a bounded sample of labelled rows (``ROWS``), whose features the
executors make and the driver gets; scoring is one pass over the documents.

Defined cases: null and empty texts have no features and get the score of the bias;
without labelled rows every score is 0.5; an empty table gives an empty table; labels of
documents that do not exist are ignored; of several labels of one document the largest
counts, and of several rows of one doc_id each is learnt from; texts with the same
features have the same score; a text of any length is read whole; columns named like the
new one (in any case) give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logweir.llm.common import SPACE, buffers, grams, mix, slices, training_rows, word_hashes

BITS = 18
#: Labelled rows that are learnt from, at most.
ROWS = 6000
EPOCHS = 3
_KIND = np.where(SPACE, 0, 2).astype(np.int8)  # 1: letters, digits and bytes of longer code points
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, and the n+1 token offsets of the rows."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    kind = _KIND[buf]
    start = np.ones(len(buf), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[off[:-1][off[1:] > off[:-1]]] = True
    s = np.flatnonzero(start & (kind > 0))
    return word_hashes(buf, s, fold=False), np.searchsorted(s, off)


def _marked(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[2:] |= h[2:] == h[:-2]
    h[same] = _AGAIN
    return h


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text with these token hashes."""
    h = _marked(h)
    every = np.concatenate([mix(h), *(grams(h, k) for k in (2, 3))]) >> np.uint64(64 - BITS)
    at, n = np.unique(every.astype(np.int32), return_counts=True)
    return at, np.sqrt(n / max(1, n.sum())).astype(np.float32)


def rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf, off = buffers(column)
    for i, j in slices(off):
        h, w = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for r in range(j - i):
            yield features(h[w[r] : w[r + 1]])


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over (label, buckets, values); the last weight is the bias."""
    z, n, w = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            y, at, x = samples[k]
            at, x = np.append(at, 2**BITS), np.append(x, np.float32(1))
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * wi
            n[at] = more
    return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = ROWS) -> np.ndarray:
    """Weights learnt from a bounded sample of the labelled documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(rows(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], ["label", "at", "x"])

    sample = training_rows(docs, labels, label, limit).mapInArrow(run, "label int, at binary, x binary")
    got = sorted((r.label, bytes(r.at), bytes(r.x)) for r in sample.toLocalIterator())
    return train([(y, np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for y, a, x in got])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    names = [c for c in docs.columns if c.lower() != name.lower() or c == text]
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            odds = np.array([w[a] @ x for a, x in rows(b.column(at))], float) + w[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-odds)))], [f"c{i}" for i in range(len(names) + 1)])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField(f"c{len(names)}", T.DoubleType())]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, name)
