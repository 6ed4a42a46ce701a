"""Line dedup: lines that many documents share stay only in one of them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
lower-cased.  Keys of ``min_chars`` code points or more that ``min_docs`` or more
documents hold lose all their lines but those in the largest ``doc_id``.

Plan: a pass over the texts gives the distinct 128-bit key hashes of each row; one
shuffle by (key, document) and one by key, both summed before they are dealt, so that
a line which all documents share costs a task one row; the keys over the threshold
meet the rows' keys again, dealt anew so that a hot key is split, and each row gets the
hashes it loses.

Defined cases: a null text is one empty line and comes back as ''; rows of one
``doc_id`` count as one document and each loses the same lines; a null ``doc_id``
counts as one document below all others; an empty table gives an empty table; a text of
any length is taken whole; other columns are kept, but those named like the counts (in any
case) give way to them if counts are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The key's hash; None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs, marks = b.columns
            rows, found = [], []
            for r in range(len(docs)):
                t = docs[r].as_py()
                if t is None or len(t) < min_chars:
                    continue
                own = {h for x in t.encode().split(b"\n") if (h := line_hash(x, min_chars))}
                rows += [r] * len(own)
                found += own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), marks.take(at), pa.array(found, pa.binary())], ["doc_id", "row", "key"])

    return run


def _drop(min_chars: int, names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lost = b.column(at), b.column(len(names))
            kept, lines, gone = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for r in range(len(texts)):
                t = texts[r].as_py() or ""
                drop = lost[r].as_py()
                if not drop:
                    lines[r] = t.count("\n") + 1
                    kept.append(t)
                    continue
                drop = set(drop)
                parts = t.encode().split(b"\n")
                stay = [x for x in parts if line_hash(x, min_chars) not in drop]
                lines[r], gone[r] = len(parts), len(parts) - len(stay)
                kept.append(b"\n".join(stay).decode())
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(gone)], [f"c{i}" for i in range(len(names) + 2)])

    return run


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row: the text's hash, lost: hashes of the lines that the row loses), for rows that lose any."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("key", T.BinaryType())])
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_keys(min_chars), schema)
    once = keys.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    many = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    # the further column has both sides dealt anew, so that adaptive execution can split a hot key
    lost = keys.withColumn("at", F.xxhash64("key")).join(many.withColumn("at", F.xxhash64("key")), ["at", "key"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "row").agg(F.collect_set("key").alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, counts: bool = True) -> DataFrame:
    """docs with ``text`` without its shared lines; counts: and n_lines (before) and n_dropped."""
    new = ["n_lines", "n_dropped"] if counts else []
    names = [c for c in docs.columns if c.lower() not in new]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    id_at, at = names.index("doc_id"), names.index("text")
    lost = shared_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row"), "lost")
    same = F.col(f"c{id_at}").eqNullSafe(F.col("lost_id")) & (F.xxhash64(f"c{at}") == F.col("lost_row"))
    both = plain.join(lost, same, "left").drop("lost_id", "lost_row")
    fields = [*plain.schema.fields, *(T.StructField(f"c{len(names) + i}", T.LongType()) for i in range(2))]
    out = both.mapInArrow(_drop(min_chars, names, at), T.StructType(fields))
    return out.select(*[f"c{i}" for i in range(len(names) + len(new))]).toDF(*names, *new)
