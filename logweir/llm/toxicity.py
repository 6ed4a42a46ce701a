"""Toxicity by compression distance: window lengths under zstandard dictionaries.

Two dictionaries are trained by zstandard: one on the windows of ordinary texts, one on
what toxic texts say beyond them.  Most of a toxic text is ordinary, so the samples of the
toxic dictionary are the words that significantly more toxic texts hold than ordinary ones
(near copies count once); where none does, they are all windows of the toxic texts.  A
window, a run of words of about ``WINDOW`` bytes, is compressed with the ordinary
dictionary and with the ordinary one continued by the toxic one; the bytes that the toxic
one saves are the distance.  Literals are stored as they are, so that what both miss does
not blur it.

A threshold on the savings and the probability of a toxic text for its windows over it are
calibrated on texts that the dictionaries have not seen: each of ``FOLDS`` parts of the
sample under dictionaries of the rest.  The model has dictionaries of the whole sample.

Fitting takes a bounded sample of labelled rows (``ROWS``, whole texts, which the driver
holds); scoring is one pass over the whole texts, without a shuffle; a text of any length
is compressed window by window.

Defined cases: null, empty and blank texts have no window and get the score of texts
without a hit; without labelled rows of both kinds every score is the share of toxic
labels that may be learnt from, 0 if there are none; of equal samples one counts, and of
several labels of a document the largest; an empty table gives an empty table; columns
that have the name of the score (in any case) give way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import SPACE, held_out, training_rows

#: Labelled rows that are learnt from, at most; half of them of either class.
ROWS = 6000
WINDOW = 48
FOLDS = 4
ORDINARY_BYTES, TOXIC_BYTES = 32768, 4096
#: Log-likelihood ratio (G squared) from which on toxic texts are taken to hold a word more often.
SURE = 20.0
#: Words in a row that an earlier text has too are a copy and no evidence; so is a text with this share of them.
COPIED, COPY = 4, 0.1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
#: What a trained dictionary has before its content: the start values of the offsets.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def windows(text: str | None) -> list[bytes]:
    """The text, A-Z lower-cased, in runs of whole words; each begins and ends with a blank."""
    raw = (text or "").encode().lower()
    b = np.frombuffer(raw, np.uint8)
    black = ~SPACE[b]
    starts = black.copy()
    starts[1:] &= ~black[:-1]
    s = np.flatnonzero(starts)
    if not len(s):
        return []
    cuts = np.unique(s[np.searchsorted(s, np.arange(0, s[-1] + 1, WINDOW))]).tolist()
    raw = b" " + raw + b" "  # a window gets the blank before its first word and the one after its last
    return [raw[a : z + 1] for a, z in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def own_words(texts: list[str]) -> list[set[bytes]]:
    """The words of each text that is no near copy, without runs of ``COPIED`` words that an earlier text has."""
    seen: set[int] = set()
    out = []
    for t in texts:
        b = np.frombuffer(t.encode().lower(), np.uint8)
        ws = np.where(_LETTER[b], b, 32).astype(np.uint8).tobytes().split()
        runs = [hash(tuple(ws[i : i + COPIED])) for i in range(len(ws) - COPIED + 1)]
        again = [i for i, g in enumerate(runs) if g in seen]
        seen.update(runs)
        if len(again) <= COPY * len(runs):
            old = {j for i in again for j in range(i, i + COPIED)}
            out.append({w for j, w in enumerate(ws) if j not in old})
    return out


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    return zstandard.train_dictionary(size, samples, k=k, d=6, level=3).as_bytes()


def content(dictionary: bytes) -> bytes:
    """A trained dictionary without its tables."""
    return dictionary.split(_OFFSETS, 1)[-1]


def excess(toxic: list[str], ordinary: list[str]) -> list[tuple[bytes, int]]:
    """Words that significantly more toxic texts hold, with the number of those texts; the commonest last."""
    own = own_words(toxic), own_words(ordinary)
    n1, n0 = (Counter(w for ws in x for w in ws) for x in own)
    a, b = (max(1, len(x)) for x in own)
    out = []
    for w, x in n1.items():
        y = n0[w]
        if len(w) > 1 and x * b > 3 * y * a:
            e = (x + y) / (a + b)
            if 2 * (x * np.log(x / (a * e)) + (y * np.log(y / (b * e)) if y else 0)) >= SURE:
                out.append((w, x))
    return sorted(out, key=lambda x: (x[1], x[0]))


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The trained ordinary dictionary, and the same with the toxic one's content behind it, where matches are cheapest."""
    plain = _trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES, 16)
    found = excess(toxic, ordinary)
    more = b" " + b" ".join(w for w, _ in found) + b" "
    if not found:
        more = content(_trained([w for t in toxic for w in windows(t)], TOXIC_BYTES, 16))
    elif len(more) > TOXIC_BYTES:  # else training would choose all there is
        more = content(_trained([b" " + w + b" " for w, n in found for _ in range(n)], TOXIC_BYTES, 16))
    return plain, plain + more


@dataclass
class Model:
    """ordinary, toxic: the dictionaries; threshold: bytes saved by a window that counts; odds: of a constant and of each figure; prior: the score of all texts of a model that could learn nothing."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 0
    odds: np.ndarray = field(default_factory=lambda: np.zeros(5))
    prior: float | None = None
    _by: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_by": None}

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if self._by is None:
            self._by = tuple(_compressor(x).compress for x in (self.ordinary, self.toxic))
        plain, both = self._by
        return np.array([len(plain(w)) - len(both(w)) for w in windows(text)], np.int64)

    def figures(self, saved: np.ndarray, threshold: int | None = None) -> np.ndarray:
        hits = int((saved >= (threshold or self.threshold)).sum())
        top = np.sort(np.append(np.maximum(saved, 0), [0, 0, 0]))[-3:]
        return np.array([1.0, np.log1p(hits), hits / max(1, len(saved)) ** 0.5, top[2] / 8, top.sum() / 24])

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.odds @ self.figures(self.savings(text)), -35, 35))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Fast matching with a target length is what makes zstandard store literals as they are."""
    how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, hash_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, and the mean loss."""
    w = np.zeros(x.shape[1])
    hold = np.full(len(w), ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -35, 35))), 1e-12, 1 - 1e-12)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def train(samples: list[tuple[int, str]], share: float) -> Model:
    """A model from (label, text); share: of toxic labels in the table, which the sample need not have."""
    rows = sorted({x for x in samples if windows(x[1])}, key=lambda x: (hash_of(x[1]), x[0]))
    try:
        parts = [[x for i, x in enumerate(rows) if i % FOLDS != k] for k in range(FOLDS)] + [rows]
        pairs = [dictionaries(*([t for y, t in part if y == k] for k in (1, 0))) for part in parts]
    except zstandard.ZstdError:  # too few texts of a kind to train on
        return Model(prior=share)
    model, folds = Model(*pairs[-1]), [Model(*x) for x in pairs[:-1]]
    saved = [folds[i % FOLDS].savings(t) for i, (_, t) in enumerate(rows)]
    labels = np.array([y for y, _ in rows], float)
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    best = np.inf
    for threshold in range(1, 13):
        x = np.array([model.figures(s, threshold) for s in saved])
        odds, loss = logistic(x, labels, weight)
        if loss < best - 1e-9:
            best, model.threshold, model.odds = loss, threshold, odds
    return model


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = ROWS) -> Model:
    """A model of a bounded sample of the labelled documents that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.agg(F.avg((F.col(label) > 0).cast("int")).alias("share")).first()["share"]
    got = training_rows(docs, labels, label, limit, balanced=True).toLocalIterator()
    return train([(r.label, r.text) for r in got if r.text], float(n or 0.0))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that the text is toxic."""
    names = [c for c in docs.columns if c.lower() != name.lower() or c == text]
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.score(t.as_py()) for t in b.column(at)], pa.float64())], [f"c{i}" for i in range(len(names) + 1)])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField(f"c{len(names)}", T.DoubleType())]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, name)
