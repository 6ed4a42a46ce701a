"""What the text operators share: reading, checkpoints, word hashing, minimisers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; their hashes fold
A-Z to a-z.  Hashes are 64-bit; a wrong equality has odds near ``n**2 / 2**64``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once; one longer text is its own slice.
SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(256, np.uint64)
_POWERS[1:] = np.cumprod(np.full(255, _BASE, np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where the session names none and all runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="logweir-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """df; has the driver collect its garbage, upon which the cleaner deletes the shuffles and checkpoints that nothing refers to any more.

    Else they stay on the disks until the driver happens to run short of memory.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's decimal text is divisible by 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(off[0]) if len(off) else 0, int(off[-1]) if len(off) else 0
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, off - lo


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the n+1 word offsets of the rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    black = ~SPACE[buf]
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    starts[first], ends[last] = black[first], black[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _STEP
    h ^= h >> np.uint64(29)
    h *= _BASE
    h ^= h >> np.uint64(32)
    return h


def word_hashes(buf: np.ndarray, s: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words that start at ``s`` and are followed by space or another word; ``fold``: A-Z as a-z."""
    global _POWERS
    if not len(s):
        return np.zeros(0, np.uint64)
    body = buf[s[0] :]
    at = s - s[0]
    lengths = np.diff(np.append(at, len(body)))
    bytes_ = (_FOLDED if fold else _BYTE)[body]
    most = int(lengths.max())
    if most > len(_POWERS):
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(most * 2, _BASE, np.uint64))])
    place = np.arange(len(body)) - np.repeat(at, lengths)
    return mix(np.add.reduceat(bytes_ * _POWERS[place], at))


def hashed_rows(column, fold: bool = True, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) for each row of a string column."""
    buf, off = buffers(column)
    for i, j in slices(off, limit):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, _, w = word_bounds(part, o)
        h = word_hashes(part, s, fold)
        for r in range(j - i):
            yield i + r, h[w[r] : w[r + 1]]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(h)-k+1 runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power = np.zeros(n, np.uint64), 0, np.uint64(1)
    block, width, step = h, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out += power * block[done : done + n]
                power = power * step
                done += width
            if width * 2 > k:
                break
            block = block[:-width] + step * block[width:]
            step = step * step
            width *= 2
    return mix(out)


def slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of w values."""
    done, out = 1, a
    while done * 2 <= w:
        out = f(out[:-done], out[done:])
        done *= 2
    return f(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def minimisers(g: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some run of w; all of equal least hashes."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    low = slide(g, w, np.minimum)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(slide(pad, w, np.maximum) == g)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, balanced: bool = False) -> DataFrame:
    """(label int, text) of at most ``rows`` labelled documents that are not held out, by the order of a hash of the id.

    ``balanced``: at most half of them from either class.  Rows without a label are left
    out; of several labels of one document the largest counts, of several texts each.
    The ids are bounded by ``rows`` before they meet the documents.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("at", F.xxhash64("doc_id"))
    kinds = [known.filter(F.col("label") == k).orderBy("at", "doc_id").limit(rows // 2) for k in (0, 1)] if balanced else [known.orderBy("at", "doc_id").limit(rows)]
    ids = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")


def texts_of(docs: DataFrame, members: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """(node, more, text) of one row for each node in wanted (node, more; a node once); the reader checks the node of the text.

    Rows are met by id and text, as many of them may have one id or none; the copies of a
    text are summed up before they are dealt.
    """
    least = members.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("at"))
    ids = wanted.join(least, "node").select("node", *more, F.col("at.doc_id").alias("wanted_id"), F.col("at.row").alias("wanted_row"))
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_row"))).select("node", *more, "text")


def spread(df: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined to other on a long ``key``, both sides dealt anew for it.

    A side that an aggregate has left dealt by the key keeps adaptive execution from
    splitting a hot key of the other; a computed key makes Spark deal both.
    """
    left, right = df.withColumn("_at", F.col(key).bitwiseXOR(F.lit(1))), other.withColumn("_at", F.col(key).bitwiseXOR(F.lit(1))).drop(key)
    return left.join(right, "_at", how).drop("_at")


def remade(df: DataFrame) -> DataFrame:
    """A checkpoint's rows without its plan's estimate of their size.

    A checkpoint keeps that estimate, which a join multiplies: in a loop its digits double
    with each round until they fill the driver's memory.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of the nodes that have links; label: the least node of the component.

    Each round takes the least label among the neighbours, tells the former label of what
    its nodes have taken, and then takes the label's own label; rounds go on until no label
    changes.  As labels are told, parts join at once however far their ends are from their
    least nodes.  Only counts reach the driver.
    """
    pair = links.select(F.col(a).alias("node"), F.col(b).alias("next"))
    edges = remade(cut(pair.unionByName(pair.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct()))
    labels = remade(cut(edges.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("label"))))
    while True:
        heard = spread(edges.select("node", F.col("next").alias("by")), labels.select(F.col("node").alias("by"), F.col("label").alias("theirs")), "by")
        least = heard.groupBy("node").agg(F.min("theirs").alias("theirs"))
        taken = remade(cut(labels.join(least, "node").select("node", "label", F.least("label", "theirs").alias("new"))))
        told = taken.groupBy("label").agg(F.min("new").alias("told")).withColumnRenamed("label", "node")
        new = taken.join(told, "node", "left").select("node", "label", F.least("new", "told").alias("new"))
        up = new.select(F.col("node").alias("new"), F.col("new").alias("up"))
        new = remade(cut(spread(new, up, "new").select("node", F.least("new", "up").alias("new"), (F.least("new", "up") != F.col("label")).alias("moved")).withColumnRenamed("new", "label")))
        labels = new.select("node", "label")
        if not new.filter("moved").take(1):
            return labels
