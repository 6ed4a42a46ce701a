"""Substring repeats by a sparse suffix array.

A repeat is a run of ``LEAST`` words or more (A-Z lower-cased) that another document's
text holds too.  Suffixes are retained where the hash of their first ``PREFIX`` words is
the least of LEAST - PREFIX + 1 in a row, so that every run of LEAST words has a retained
suffix, chosen by its content alone.

Plan: retained suffixes are sorted over the whole cluster by their beginning, and
neighbours in that order are compared; equal beginnings may be many partitions long, as
the order goes on by text and place, and what a partition's ends leave open is decided by
a summary of two rows of each partition.  From a suffix that has a neighbour in another
text, the match is extended left and right: each run of LEAST words around it goes
through the same sort and comparison, and runs that follow each other make a span.
Texts with the same words are one text in this, and get their spans back at the end.

Defined cases: null, empty and short texts have no repeats; rows of one ``doc_id`` with
the same words are one document, with different words they are different texts of it; a
passage that occurs only within one document is no repeat; texts of LEAST words or more
that another document has as a whole are one span; an empty table has no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import cut, grams, hashed_rows, minimisers, signed, slide, spread, texts_of
from logweir.llm.near_dedup import node

#: Words of a repeat, at least.
LEAST = 50
#: Words at the beginning of a suffix that neighbours are compared by.
PREFIX = 20
_FOUND, _OPEN, _RUN = 0, 1, 2


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_words, row) of each row; node: a number for the words, null if there are none; row: a hash of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(node(h), len(h)) if len(h) else (None, 0) for _, h in hashed_rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.int64()), b.column(2)], ["doc_id", "node", "n_words", "row"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("node", "n_words", "row"))])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, schema)


def once(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """make(node, word hashes) gives arrays (keys, places) for each text; a task makes each text once."""
    seen: set[int] = set()
    for b in batches:
        keys, nodes, places = [], [], []
        for _, h in hashed_rows(b.column(0)):
            if not len(h) or (n := node(h)) in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(n)
            k, p = make(n, h)
            keys.append(k)
            places.append(p)
            nodes.append(np.full(len(k), n, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, places)], ["key", "node", "pos"])


def suffixes(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """(key, node, pos): the retained suffixes, key for their first words."""

    def make(_: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = grams(h, prefix)
        at = minimisers(g, least - prefix + 1) if len(h) >= least else np.zeros(0, np.int64)
        return signed(g[at]), at.astype(np.int64)

    return docs.select("text").mapInArrow(lambda batches: once(batches, make), "key long, node long, pos long")


_SCHEMA = "kind int, key long, node long, pos long, other long, other_pos long, before long, before_pos long"


def _rows(kind: int, key, node, pos, other, other_pos, before=None, before_pos=None, some=None) -> pa.RecordBatch:
    """some: where there is a before."""
    n = len(node)
    none = np.ones(n, bool) if some is None else ~some
    last = [pa.array(np.zeros(n, np.int64) if x is None else x, mask=none) for x in (before, before_pos)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (key, node, pos, other, other_pos)), *last], [x.split()[0] for x in _SCHEMA.split(", ")])


class _Run:
    """The equal keys that the rows seen so far end with: the first and last row, the first row of a second node, and the places that wait for one."""

    def __init__(self, key, first, second, last, open_, opens):
        self.key, self.first, self.second, self.last, self.open, self.opens = key, first, second, last, open_, opens

    def edge(self) -> list[pa.RecordBatch]:
        n = len(self.open)
        same = [np.full(n, x, np.int64) for x in (self.key, self.first[0], self.first[0], self.first[1])]
        second = [np.full(1, x) for x in self.second] if self.second else [None, None]
        return [_rows(_RUN, [self.key], [self.first[0]], [self.first[1]], [self.last[0]], [self.last[1]], *second, np.full(1, self.second is not None)), _rows(_OPEN, same[0], same[1], self.open, same[2], same[3])]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node, pos) -> what is found, left open, and the first and last run of the partition.

    Found rows have the first other node of their run and the node of the row before, if it
    is another one than their own.  Runs have their first row, their last one and, as
    before, the first one of a second node.
    """
    run: _Run | None = None
    for b in batches:
        key, node, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        goes_on = run is not None and key[0] == run.key
        if run is not None and not goes_on and run.opens:
            yield from run.edge()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        first, first_pos = node[starts].copy(), pos[starts].copy()
        before, before_pos = np.roll(node, 1), np.roll(pos, 1)
        some = ~new
        if goes_on:
            first[0], first_pos[0] = run.first
            before[0], before_pos[0], some[0] = *run.last, True
        differs = node != first[of]
        some &= differs & (before != node)
        at = np.flatnonzero(differs)[::-1]
        second, second_pos, known = first.copy(), first_pos.copy(), np.zeros(len(starts), bool)
        second[of[at]], second_pos[of[at]], known[of[at]] = node[at], pos[at], True  # the first of each run stays
        if goes_on and run.second is not None:
            (second[0], second_pos[0]), known[0] = run.second, True
        if goes_on and known[0] and len(run.open):
            n = len(run.open)
            yield _rows(_FOUND, *(np.full(n, x) if np.ndim(x) == 0 else x for x in (key[0], run.first[0], run.open, second[0], second_pos[0])))
        found = differs | known[of]
        theirs, places = np.where(differs, first[of], second[of]), np.where(differs, first_pos[of], second_pos[of])
        yield _rows(_FOUND, *(x[found] for x in (key, node, pos, theirs, places, before, before_pos, some)))

        opens, last = run is None or (goes_on and run.opens), len(starts) - 1
        waiting = run.open if goes_on else np.zeros(0, np.int64)
        end = starts[1] if last else len(key)
        mine = np.zeros(0, np.int64) if known[0] else np.unique(np.concatenate([waiting, pos[:end]]))
        run = _Run(key[0], (first[0], first_pos[0]), (second[0], second_pos[0]) if known[0] else None, (node[end - 1], pos[end - 1]), mine, opens)
        if last:
            if opens:  # the partition's first run ends in this batch
                yield from run.edge()
            z = starts[last]
            run = _Run(key[-1], (first[last], first_pos[last]), (second[last], second_pos[last]) if known[last] else None, (node[-1], pos[-1]), np.zeros(0, np.int64) if known[last] else np.unique(pos[z:]), False)
    if run is not None:
        yield from run.edge()


def _ordered(rows: DataFrame) -> DataFrame:
    order = rows.repartitionByRange("key", "node", "pos").sortWithinPartitions("key", "node", "pos")
    return cut(order.mapInArrow(_neighbours, _SCHEMA))


def shared(rows: DataFrame) -> DataFrame:
    """The rows (key, node, pos) whose key another node has too, as (node, pos, other, other_pos).

    other: the first node in order that has the key, of the part of the order that a task
    has; for that node itself, the second.
    """
    out = _ordered(rows)
    low, high = F.min(F.struct("node", "pos")).alias("low"), F.max(F.struct(F.col("other").alias("node"), F.col("other_pos").alias("pos"))).alias("high")
    runs = out.filter(F.col("kind") == _RUN).groupBy("key").agg(low, high).filter("low.node <> high.node")
    # at most two rows of each partition, hence safe to broadcast
    other = F.when(F.col("node") == F.col("low.node"), F.col("high")).otherwise(F.col("low"))
    late = out.filter(F.col("kind") == _OPEN).join(F.broadcast(runs), "key").withColumn("theirs", other)
    late = late.select("node", "pos", F.col("theirs.node").alias("other"), F.col("theirs.pos").alias("other_pos"))
    return out.filter(F.col("kind") == _FOUND).select(*late.columns).unionByName(late)


def partners(rows: DataFrame) -> DataFrame:
    """As ``shared``, with the partners of the whole order, however it is dealt; and (before, before_pos), the node before in order, null if it is the same as either."""
    out = _ordered(rows)
    # at most two rows of each partition, hence safe to broadcast
    ends = out.filter(F.col("kind") == _RUN).select("key", "node", "pos", F.struct(F.col("other").alias("node"), F.col("other_pos").alias("pos")).alias("last"), F.struct(F.col("before").alias("node"), F.col("before_pos").alias("pos")).alias("second"))
    ends = ends.withColumn("low", F.min(F.struct("node", "pos")).over(Window.partitionBy("key"))).withColumn("left", F.lag("last").over(Window.partitionBy("key").orderBy("node", "pos")))
    another = lambda c: F.min(F.when(F.col(f"{c}.node") != F.col("low.node"), F.col(c)))
    runs = ends.withColumn("own", F.struct("node", "pos")).groupBy("key").agg(F.first("low").alias("low"), F.least(another("own"), another("second")).alias("second"))
    heads = ends.filter("left IS NOT NULL").select("key", "node", "pos", "left")

    met = out.filter(F.col("kind") != _RUN).join(F.broadcast(runs), "key", "left").join(F.broadcast(heads), ["key", "node", "pos"], "left")
    met = met.withColumn("theirs", F.when(F.col("low").isNull(), F.struct(F.col("other").alias("node"), F.col("other_pos").alias("pos"))).when(F.col("node") == F.col("low.node"), F.col("second")).otherwise(F.col("low")))
    met = met.withColumn("left", F.coalesce("left", F.struct(F.col("before").alias("node"), F.col("before_pos").alias("pos")))).filter("theirs.node IS NOT NULL")
    some = (F.col("left.node") != F.col("node")) & (F.col("left.node") != F.col("theirs.node")) & (F.col("node") != F.coalesce(F.col("low.node"), F.col("node") + 1))
    return met.select("key", "node", "pos", F.col("theirs.node").alias("other"), F.col("theirs.pos").alias("other_pos"), F.when(some, F.col("left.node")).alias("before"), F.when(some, F.col("left.pos")).alias("before_pos"))


def _extended(least: int, prefix: int):
    """Rows (node, places of shared suffixes, text) -> the runs of ``least`` words whose own suffix is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).to_pylist()
            for r, h in hashed_rows(b.column(2)):
                if len(h) < least or node(h) != wanted[r]:
                    continue
                g, w = grams(h, prefix), least - prefix + 1
                kept = np.full(len(g), 2**64 - 1, np.uint64)
                at = np.array(b.column(1)[r].as_py(), np.int64)
                kept[at] = g[at]
                pos = np.flatnonzero(slide(kept, w, np.minimum) == slide(g, w, np.minimum))
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams(h, least)[pos])), pa.array(np.full(len(pos), wanted[r], np.int64)), pa.array(pos.astype(np.int64))], ["key", "node", "pos"])

    return run


def _spans(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                own = dict(sorted((x["pos"], x["other"]) for x in b.column(1)[r].as_py()))
                at = np.array(list(own), np.int64)
                starts = np.flatnonzero(np.diff(at, prepend=at[0] - least - 1) > least)
                ends = [*(starts[1:] - 1), len(at) - 1]
                out += [(b.column(0)[r].as_py(), int(at[a]), int(at[z]) - int(at[a]) + least, own[int(at[a])]) for a, z in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["node", "start", "length", "other"])

    return run


def repeats(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, start, length, other_id): each maximal span of repeated words, and a document that holds its beginning too.

    start and length count words.
    """
    own = cut(members(docs))
    seeds = shared(suffixes(docs, least, prefix)).groupBy("node").agg(F.collect_set("pos").alias("places"))
    runs = texts_of(docs, own, seeds, "places").mapInArrow(_extended(least, prefix), "key long, node long, pos long")
    spans = cut(shared(runs).groupBy("node").agg(F.collect_list(F.struct("pos", "other")).alias("own")).mapInArrow(_spans(least), "node long, start long, length long, other long"))

    copies = copied(own, least)
    single = spread(spread(spans, copies.filter("NOT copied").select("node"), "node"), copies.select(F.col("node").alias("other"), F.col("low").alias("other_id")), "other")
    a = spread(rows_of(own), single.select("node", "start", "length", "other_id"), "node").select("doc_id", "start", "length", "other_id")
    return a.unionByName(whole(own, copies))


def rows_of(own: DataFrame) -> DataFrame:
    return own.select("doc_id", "node").filter("node IS NOT NULL").distinct()


def copied(own: DataFrame, least: int) -> DataFrame:
    """(node, low, high: its documents, n_words, copied: whether several documents have it and it is long enough)."""
    ids = own.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n_words").alias("n_words"))
    return cut(ids.withColumn("copied", F.coalesce(F.col("low") != F.col("high"), F.lit(False)) & (F.col("n_words") >= least)))


def whole(own: DataFrame, copies: DataFrame, *more: str) -> DataFrame:
    """(doc_id, start, length, other_id, more: columns of copies) of the documents whose words another document has as a whole."""
    both = spread(rows_of(own), copies.filter("copied").drop("copied"), "node")
    other = F.when(F.col("doc_id").eqNullSafe(F.col("low")), F.col("high")).otherwise(F.col("low"))
    return both.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"), other.alias("other_id"), *more)
