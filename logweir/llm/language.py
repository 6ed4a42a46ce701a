"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that consist of small letters, with or
without the mark of a word's beginning, and any single letter besides.  For each language
expectation-maximisation learns how likely each piece is.  The probability of a word is
the sum over all ways to cut it into pieces, which a forward pass over its letters
yields; a text's is the product of its words'.  The language with the largest one is
predicted, all languages being equally likely beforehand.

Words are runs of letters in lower case, of any length: the sums of a run of over ``WORD``
letters are scaled as they go.  Fitting takes a bounded sample of the distinct texts of
each language (about ``ROWS``, by a hash, one at least); it learns from longer runs in
parts of ``WORD`` letters.  Scoring is one pass over the whole texts, in which a worker
scores a word once and then keeps its sums in a bounded table.

Defined cases: a null text or one without letters has the language ``und`` and score 0,
as has every text if no language could be learnt; copies of a text count once in
learning; of several languages with the same probability the first in alphabetical order;
an empty table gives an empty table; more than ``LANGUAGES`` languages are an error;
columns named like the new ones (in any case) give way to them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import mix

#: Distinct texts of each language that are learnt from, about.
ROWS = 500
#: Languages that a model can hold; more raise an error.
LANGUAGES = 2000
#: Letters of a run that is looked at among others of its length; longer ones are looked at one by one.
WORD = 48
ROUNDS = 4
#: Words that a worker keeps with their sums.
KEPT_WORDS = 300_000
_MARK = "▁"
_RUNS = regex.compile(r"\p{L}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _RUNS.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """Pieces of letters in the sentencepiece model at ``path``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(x for x in own if (y := x.removeprefix(_MARK)) and y == y.lower() and _RUNS.fullmatch(y))


class Pieces:
    """Finds the numbers of all pieces within words; one more number stands for a letter that is no piece."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._key(x) for x in pieces], np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.ids[at[todo]] < 0
            self.keys[at[todo][free]], self.ids[at[todo][free]] = keys[todo][free], todo[free]
            todo = todo[self.ids[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c)) % 2**64
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at, out, todo = self._slot(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(todo):
            seen = self.ids[at[todo]]
            hit = (seen >= 0) & (self.keys[at[todo]] == keys[todo])
            out[todo[hit]] = seen[hit]
            todo = todo[~hit & (seen >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out

    def spans(self, letters: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For an (n, length) array of code points with the mark first, (start, end): the numbers of these parts, -1 for none.

        The mark is no piece by itself: a part that begins with it has a letter too.
        """
        n, length = letters.shape
        out = {}
        for a in range(length):
            key = np.zeros(n, np.uint64)
            for z in range(a + 1, min(length, a + self.longest) + 1):
                key = key * _STEP + letters[:, z - 1]
                if a == 0 and z == 1:
                    continue
                found = self.find(key)
                if z - a == 1 or (a == 0 and z == 2):
                    found = np.where(found < 0, self.size - 1, found)
                out[a, z] = found
        return out

    def grouped(self, own: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in own, code points with the mark first) of the words of each length."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            by.setdefault(len(w), []).append(i)
        for length, at in by.items():
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                flat = np.frombuffer("".join(_MARK + own[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield np.array(part), flat.reshape(len(part), length + 1).astype(np.uint64)


def forward(spans: dict[tuple[int, int], np.ndarray], length: int, p: np.ndarray) -> list[np.ndarray]:
    """Sums over the segmentations of the first 0 .. length letters; p: (pieces, languages)."""
    n = len(next(iter(spans.values())))
    out = [np.ones((n, p.shape[1]))] + [np.zeros((n, p.shape[1])) for _ in range(length)]
    for (a, z), found in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0])):
        if len(at := np.flatnonzero(found >= 0)):
            out[z][at] += out[a][at] * p[found[at]]
    return out


def long_logs(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """The log of the sum over all segmentations of one word of any length."""
    letters = np.frombuffer((_MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length, most = len(letters), pieces.longest
    key, ends = np.zeros(length, np.uint64), np.full((length + 1, most + 1), -1, np.int32)
    for k in range(1, most + 1):  # parts of k letters, by their ends
        n = length - k + 1
        if n <= 0:
            break
        key = key[:n] * _STEP + letters[k - 1 :]
        found = pieces.find(key)
        if k == 1:
            found = np.where(found < 0, pieces.size - 1, found)
            found[0] = -1
        elif k == 2 and found[0] < 0:
            found[0] = pieces.size - 1
        ends[k:, k] = found
    sums, logs = np.zeros((length + 1, p.shape[1])), np.zeros(p.shape[1])
    sums[0] = 1
    for z in range(1, length + 1):
        own = np.flatnonzero(ends[z] >= 0)
        if len(own):
            sums[z] = (sums[z - own] * p[ends[z, own]]).sum(0)
        if z % 16 == 0:  # the last ``most`` sums are scaled together
            low = max(0, z - most)
            top = np.maximum(sums[low : z + 1].max(0), 1e-300)
            sums[low : z + 1] /= top
            logs += np.log(top)
    return logs + np.log(np.maximum(sums[length], 1e-300))


def learn(pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the pieces' probabilities, from the words' counts in each language."""
    langs = sorted(counts)
    own = sorted({w for c in counts.values() for w in c})
    often = np.array([[counts[x].get(w, 0) for x in langs] for w in own], float).reshape(len(own), len(langs))
    p = np.full((pieces.size, len(langs)), 1 / pieces.size)
    for _ in range(rounds):
        seen = np.full(p.shape, 0.01)
        for at, letters in pieces.grouped(own):
            spans, length = pieces.spans(letters), letters.shape[1]
            before = forward(spans, length, p)
            after = [np.zeros_like(before[0]) for _ in range(length)] + [np.ones_like(before[0])]
            share = often[at] / np.maximum(before[length], 1e-300)
            for a in range(length - 1, -1, -1):
                for z in range(a + 1, min(length, a + pieces.longest) + 1):
                    if (found := spans.get((a, z))) is not None and len(i := np.flatnonzero(found >= 0)):
                        tail = p[found[i]] * after[z][i]
                        after[a][i] += tail
                        np.add.at(seen, found[i], before[a][i] * tail * share[i])
        p = seen / seen.sum(0)
    return langs, p


class Model:
    """Scores words and texts; pickles without its table."""

    def __init__(self, pieces: Pieces, langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p
        self._at: dict[str, int] = {}
        self._sums = np.zeros((1024, len(langs)), np.float32)

    def __getstate__(self):
        return (self.pieces, self.langs, self.p)

    def __setstate__(self, state):
        self.__init__(*state)

    def logs(self, own: list[str]) -> np.ndarray:
        """Log probabilities of the words in each language."""
        out = np.zeros((len(own), len(self.langs)), np.float32)
        for at, letters in self.pieces.grouped(own):
            whole = forward(self.pieces.spans(letters), letters.shape[1], self.p)[-1]
            out[at] = np.log(np.maximum(whole, 1e-300))
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior probability of each text."""
        found = [words(t) for t in texts] if self.langs else [[] for _ in texts]
        new = {w for ws in found for w in ws if len(w) <= WORD and w not in self._at}
        if len(self._at) + len(new) > KEPT_WORDS:
            self._at = {}
            new = {w for ws in found for w in ws if len(w) <= WORD}
        if new:
            own, n = sorted(new), len(self._at)
            self._at.update(zip(own, range(n, n + len(own)), strict=True))
            if n + len(own) > len(self._sums):
                self._sums = np.concatenate([self._sums[:n], np.zeros((n + 2 * len(own), len(self.langs)), np.float32)])
            self._sums[n : n + len(own)] = self.logs(own)
        out = []
        for ws in found:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self._sums[[self._at[w] for w in ws if len(w) <= WORD]].sum(0, dtype=np.float64)
            for w in ws:
                if len(w) > WORD:
                    total += long_logs(self.pieces, w, self.p)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(docs: DataFrame, vocabulary_path: str, rows: int = ROWS) -> Model:
    """A model of the (text, lang) of ``docs``; the caller leaves out what must not be learnt."""
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 2)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", draw.alias("draw"))
    kinds = known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(kinds) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    pieces = Pieces(vocabulary(vocabulary_path))
    if not kinds:
        return Model(pieces, [], np.zeros((pieces.size, 0)))
    most = F.create_map(*[F.lit(x) for r in kinds for x in (r["lang"], max(r["least"], int(min(1.0, rows / r["n"]) * (2**62 - 1))))])
    sample = known.filter(F.col("draw") <= most[F.col("lang")]).select("text", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t, x in zip(b.column(0), b.column(1), strict=True):
                for w in words(t.as_py()):
                    for k in range(0, len(w), WORD):
                        seen[x.as_py(), w[k : k + WORD]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    return Model(pieces, *learn(pieces, counts))


def predicted(docs: DataFrame, model: Model, text: str = "text", batch: int = 256) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language."""
    new = ["lang_pred", "score"]
    names = [c for c in docs.columns if c.lower() not in new or c == text]
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                got = own.texts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [f"c{i}" for i in range(len(names) + 2)])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    fields += [T.StructField(f"c{len(names)}", T.StringType()), T.StructField(f"c{len(names) + 1}", T.DoubleType())]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, *new)
