"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space is collapsed.  A test item of m characters
may be met with up to ``rate * m`` edits (insertions, deletions, substitutions).  It is
split into one piece more than that, so that one piece is met exactly wherever the item
is met within its budget; an automaton finds all pieces in one pass over each text, and
Myers' bit-parallel distance decides around each hit.

Items are taken in blocks of bounded size, each broadcast and held against all
documents; documents are never shuffled.

Defined cases: null or empty texts and items match nothing; equal items each match; of
several places with the least distance the first counts; rows of one doc_id are looked at
each by itself; a text of any length is searched whole, and only what lies around hits is
aligned; other columns of the documents are kept, whatever their names; an empty table on
either side has no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Share of an item's characters that may differ.
RATE = 0.05
#: Characters of items that are held against the documents at once.
BLOCK = 1_000_000


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    n = min(errors + 1, len(item))
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any part of the text and the first end of such a part; None over ``most``.

    Bit i of the vectors stands for row i of the table; a column costs a few operations
    on integers of len(pattern) bits.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diag | up) & full, up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | ~(diag | right) & full, right & diag
        if score < best:
            best, end = score, j + 1
            if not score:
                break
    return (best, end) if best <= most else None


class Items:
    """A block of items with the automaton of their pieces; pickles without it."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items, self.rate, self._found = items, rate, None

    def __getstate__(self):
        return (self.items, self.rate)

    def __setstate__(self, state):
        self.items, self.rate = state
        self._found = None

    def automaton(self):
        if self._found is None:
            places: dict[str, list[tuple[int, int]]] = {}
            for k, (_, t) in enumerate(self.items):
                for at, piece in pieces(t, budget(t, self.rate)):
                    places.setdefault(piece, []).append((k, at))
            self._found = ahocorasick.Automaton()
            for piece, where in places.items():
                self._found.add_word(piece, (len(piece), where))
            self._found.make_automaton()
        return self._found

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, distance, end in the text) of each item that the plain text holds."""
        near: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton().iter(text):
            for k, at in where:
                near.setdefault(k, []).append(end + 1 - length - at)
        out = []
        for k, starts in sorted(near.items()):
            item = self.items[k][1]
            e = budget(item, self.rate)
            if (at := text.find(item)) >= 0:
                out.append((k, 0, at + len(item)))
                continue
            best: tuple[int, int] | None = None
            starts.sort()
            i = 0
            while i < len(starts):  # windows that overlap are looked at as one
                j = i
                while j + 1 < len(starts) and starts[j + 1] - e <= starts[j] + len(item) + e:
                    j += 1
                lo = max(0, starts[i] - e)
                found = myers(item, text[lo : starts[j] + len(item) + e], best[0] - 1 if best else e)
                if found:
                    best = (found[0], lo + found[1])
                    if not best[0]:
                        break
                i = j + 1
            if best:
                out.append((k, *best))
        return out


def blocks(benchmark: DataFrame, rate: float = RATE, size: int = BLOCK) -> Iterator[Items]:
    """The items (item_id, text) in blocks; each has less than ``size`` characters, or one item."""
    own: list[tuple[object, str]] = []
    total = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        t = plain(text)
        if not t:
            continue
        if own and total + len(t) > size:
            yield Items(own, rate)
            own, total = [], 0
        own.append((item, t))
        total += len(t)
    if own:
        yield Items(own, rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, size: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, match_end): each item that a document holds within its budget.

    match_end is a place in the plain text.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("distance", T.LongType()), T.StructField("match_end", T.LongType())])
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, rate, size):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held, kind=kind) -> Iterator[pa.RecordBatch]:
            own = held.value
            for b in batches:
                rows, found = [], []
                for r, t in enumerate(b.column(1)):
                    hits = own.matches(plain(t.as_py()))
                    rows += [r] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([own.items[k][0] for k, _, _ in found], kind), *(pa.array([x[c] for x in found], pa.int64()) for c in (1, 2))], schema.names)

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, size: int = BLOCK) -> DataFrame:
    """The rows of docs whose texts hold no item."""
    names = docs.columns
    out = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    schema, at = out.schema, names.index("text")
    for block in blocks(benchmark, rate, size):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not held.value.matches(plain(t.as_py())) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*names)
