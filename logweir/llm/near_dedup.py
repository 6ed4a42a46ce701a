"""MinHash near-dedup: signatures, banding, verification, classes.

Texts are compared as sets of shingles of five words, A-Z lower-cased (a text of one to
four words has one shingle).  A shingle's weight in a signature is 1 + ln(its count).
Every shingle sends arrivals of a Poisson process with its weight as rate to registers
drawn at random; a register keeps its first arrival's shingle, and a shingle stops once
its next arrival is later than all registers of its text.  Two registers agree with the
probability Jaccard of the weighted sets; ``ROWS`` of them make a band.

Plan: rows with the same words share a node, so copies cost a row each and no more.
Each band bucket gives every member an edge to one member, drawn anew for each bucket;
edges are verified by the exact Jaccard of the sets, and verified edges make components.
Buckets in which several components remain go through an exact prefix-filtered set join
with a positional bound, between components only, so that no link is lost which a member
has to others than the drawn one.  A pair at 0.8 meets in no bucket with odds of
(1 - 0.8**ROWS)**BANDS, 3e-5.

Defined cases: a text without words (null, empty, blank) is a class of its own; rows of
one ``doc_id`` are looked at each by itself; a class has the least doc_id of its rows as
its id, null if all are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import components, cut, grams, hashed_rows, mix, signed, spread, texts_of

WORDS = 5
BANDS, ROWS = 26, 5
#: Similarity of near duplicates in hundredths.
LEAST = 80
#: Shingles whose signatures are made together.
_LOT = 1 << 18
#: Longs of the bitmap that bounds how many items of two sets differ.
PARITY = 8
_SEED = np.uint64(0x2545F4914F6CDD1D)


def shingles(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words; of all words if they are fewer."""
    return grams(h, min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def node(h: np.ndarray) -> int:
    """A number for the sequence of words."""
    return int(signed(grams(h, len(h)) ^ mix(np.array([len(h)], np.uint64)))[0])


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """For (shingles, weights) of several texts, the shingle that comes first in each register."""
    m = registers
    row = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    what = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    first, who = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    time, state = np.zeros(len(what)), mix(what ^ _SEED)
    while len(what):
        state = mix(state + _SEED)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        at = row * m + (mix(state) % np.uint64(m)).astype(np.int64)
        soon = time < first[at]
        at, t, w = at[soon], time[soon], what[soon]
        np.minimum.at(first, at, t)
        won = first[at] == t
        who[at[won]] = w[won]
        go = time < first.reshape(-1, m).max(1)[row]
        row, what, weight, time, state = row[go], what[go], weight[go], time[go], state[go]
    return who.reshape(-1, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """For an (n, BANDS * ROWS) array, (n, BANDS) keys that are equal where a band is."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _SEED + parts[:, :, r])
    return key


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [node(h) if len(h) else None for _, h in hashed_rows(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), b.column(2)], ["doc_id", "node", "row"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()

    def made(nodes: list[int], sets: list) -> pa.RecordBatch:
        keys = band_keys(signatures(sets))
        return pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.repeat(np.array(nodes, np.int64), BANDS))], ["key", "node"])

    for b in batches:
        nodes, sets, size = [], [], 0
        for _, h in hashed_rows(b.column(0)):
            if not len(h) or (n := node(h)) in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(n)
            s = np.unique(shingles(h))
            nodes.append(n)
            sets.append((s, np.ones(len(s))))
            size += len(s)
            if size > _LOT:
                yield made(nodes, sets)
                nodes, sets, size = [], [], 0
        if nodes:
            yield made(nodes, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, its shingles as sorted 32-bit numbers), for rows (wanted node, text)."""
    for b in batches:
        nodes, out = [], []
        wanted = b.column(0).to_pylist()
        for r, h in hashed_rows(b.column(1)):
            if len(h) and node(h) == wanted[r]:
                nodes.append(wanted[r])
                out.append(np.unique((shingles(h) >> np.uint64(32)).astype(np.uint32)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "items"])


def alike(x: np.ndarray, y: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least / 100."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < least * max(n, m):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= least * (n + m - same)


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [alike(np.frombuffer(x[r].as_buffer(), np.uint32), np.frombuffer(y[r].as_buffer(), np.uint32), least) for r in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike."""
    both = spread(pairs, sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = spread(both, sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            own = np.frombuffer(b.column(2)[r].as_buffer(), np.uint32).astype(np.int64)
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0).take(pa.array([r] * n, pa.int64())), b.column(1).take(pa.array([r] * n, pa.int64())), pa.array(np.full(n, n, np.int64))], ["item", "node", "label", "n"])


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, PARITY * 64 bits: whether an odd number of items falls on each)."""
    for b in batches:
        out = []
        for x in b.column(1):
            own = np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64)
            odd = np.bincount((mix(own) % np.uint64(PARITY * 64)).astype(np.int64), minlength=PARITY * 64) % 2
            out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        bits = np.array(out, np.int64).reshape(-1, PARITY)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(bits[:, k]) for k in range(PARITY))], ["node", *(f"p{k}" for k in range(PARITY))])


def missed_pairs(nodes: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of nodes (node, label) of different labels that may be alike, by rarest items first.

    A set of n items that is alike to another shares one of its n - ceil(n t) + 1 rarest
    items with it; at the first shared item the rest of either set bounds the overlap, and
    so does the number of bits in which the sets' parity bitmaps differ: no two sets differ
    in fewer items.
    """
    items = cut(nodes.join(sets, "node").select("node", "label", "items").mapInArrow(_items, "item long, node long, label long, n long"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ranked = spread(items, often, "item").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("own"))
    prefix = F.slice("own", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least / F.lit(100)) + 1).cast("int"))
    ranked = ranked.select("node", "label", "n", F.posexplode(prefix).alias("at", "it")).filter("it.often > 1")
    bits = [f"p{k}" for k in range(PARITY)]
    parity = nodes.select("node").join(sets, "node").select("node", "items").mapInArrow(_parity, ", ".join(f"{c} long" for c in ["node", *bits]))
    own = ["node", "label", "n", "rest", *bits]
    first = cut(ranked.select(F.col("it.item").alias("item"), "node", "label", "n", (F.col("n") - F.col("at")).alias("rest")).join(parity, "node"))
    a, b = (first.select("item", *[F.col(c).alias(f"{x}_{c}") for c in own]) for x in "ab")
    total = F.col("a_n") + F.col("b_n")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bits), F.lit(0))
    enough = (F.least("a_rest", "b_rest") * (100 + least) >= least * total) & ((total - differ) * (100 + least) >= 2 * least * total)
    return a.join(b, (a["item"] == b["item"]) & (F.col("a_label") < F.col("b_label")) & enough).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def classes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, n_class: rows of the class, stands: whether the row stands for it, node) for each row of docs."""
    pair = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("node", T.LongType()), T.StructField("row", T.LongType())])
    members = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_members, schema))
    banded = pair.select("text").mapInArrow(_bands, "key long, node long").distinct()
    hubs = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node"))["node"].alias("hub")).filter("size > 1")
    shared = cut(spread(banded, hubs, "key"))

    sets = texts_of(docs, members, shared.select("node").distinct()).select("node", "text").mapInArrow(_sets, "node long, items binary")
    sets = cut(sets.groupBy("node").agg(F.first("items").alias("items")))

    edges = shared.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = cut(verified(edges, sets, least))
    labels = components(links)

    known = cut(shared.filter("size > 2").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_ = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    undecided = cut(spread(known, open_, "key").select("node", "label").distinct())
    if undecided.take(1):
        more = cut(verified(missed_pairs(undecided, sets, least), sets, least))
        if more.take(1):
            labels = components(links.unionByName(more))

    joined = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    named = joined.filter("label IS NOT NULL").groupBy("label").agg(first, F.count(F.lit(1)).alias("n_class"))
    out = spread(joined, named, "label", "left")
    alone = F.col("label").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stands = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node")))
    return out.select("doc_id", class_id.alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("n_class")).alias("n_class"), stands.alias("stands"), "node")


def first_of_each(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs that stand for their class: those of its least doc_id."""
    names = docs.columns
    at = names.index("text")
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    new = [*plain.columns, "own_node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [node(h) if len(h) else None for _, h in hashed_rows(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], new)

    fields = [*plain.schema.fields, T.StructField("own_node", T.LongType())]
    gone = classes(docs, least).filter(~F.col("stands")).select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")).distinct()
    own = F.col(f"c{names.index('doc_id')}")
    left = plain.mapInArrow(run, T.StructType(fields)).join(gone, own.eqNullSafe(F.col("gone_id")) & (F.col("own_node") == F.col("gone_node")), "left_anti")
    return left.drop("own_node").toDF(*names)
