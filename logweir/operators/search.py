"""Pages, totals, histograms, fetching by id, export and field selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.scalar import floor_to, id_parts, id_text
from logweir.operators.table import LogTable
from logweir.plans.ast import Fields

#: Fixed value: ids that one call fetches or exports, at most.
MOST = 100_000


class RequestError(ValueError):
    pass


def page(table: LogTable, matching: DataFrame, size: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """``size`` documents in order of time after the first ``offset``, each once.

    Only as many rows as the page needs leave a partition.
    """
    if size < 0 or offset < 0:
        raise RequestError("size and offset must not be negative")
    turn = (lambda c: c.asc()) if ascending else (lambda c: c.desc())
    rows = matching.withColumns({"_mid": table.mid, "_rid": table.rid})
    if "nested_path" in rows.columns:  # a document's own row and those of its elements have one id
        if size > MOST:
            rows = rows.dropDuplicates(["_mid", "_rid"])
        else:  # only ids are dealt; the page's, as many as ``size`` says, find their rows
            ids = rows.select("_mid", "_rid").distinct().orderBy(turn(F.col("_mid")), turn(F.col("_rid"))).offset(offset).limit(size)
            rows, offset = rows.join(F.broadcast(ids), ["_mid", "_rid"], "left_semi").dropDuplicates(["_mid", "_rid"]), 0
    return rows.orderBy(turn(F.col("_mid")), turn(F.col("_rid"))).offset(offset).limit(size).drop("_mid", "_rid")


def recent(table: LogTable, matching: DataFrame, size: int, days: list[str], ascending: bool = False) -> list:
    """The rows of ``page``, day by day from the end that the page begins at, until there are enough.

    days: those of a stored table (``store.days``), oldest first.  Each round looks at twice
    as many as the one before, so that a page of the newest reads a day or two of years.
    """
    if table.day is None:
        raise RequestError("the table has no days")
    out, left, step = [], list(days) if ascending else list(days)[::-1], 1
    while left and len(out) < size:
        batch, left, step = left[:step], left[step:], step * 2
        rows = matching.filter(table.day.isin(*[F.lit(d).cast("date") for d in batch]))
        out += page(table, rows, size - len(out), ascending=ascending).collect()
    return out


def histogram(table: LogTable, matching: DataFrame, interval_ms: int) -> DataFrame:
    """(bucket, docs): rows by time, without empty buckets."""
    if interval_ms <= 0:
        raise RequestError("interval must be positive")
    return matching.groupBy(floor_to(table.mid, interval_ms).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))


def selected(doc: Column, fields: Fields | None) -> Column:
    """A document's text with some of its top-level keys; other documents than objects stay as they are."""
    if fields is None:
        return doc
    names = F.array(*map(F.lit, fields.names))
    keys = F.from_json(doc, "map<string,variant>")
    chosen = F.map_filter(keys, lambda k, _: ~F.array_contains(names, k) if fields.leave_out else F.array_contains(names, k))
    return F.when(keys.isNotNull(), F.to_json(chosen)).otherwise(doc)


def wanted(spark, ids: Iterable[str]) -> DataFrame:
    """(pos, mid, rid) of well-formed ids; others are left out."""
    rows = []
    for i, s in enumerate(ids):
        if i >= MOST:
            raise RequestError(f"too many ids, at most {MOST}")
        try:
            rows.append((i, *id_parts(s)))
        except ValueError:
            continue
    return spark.createDataFrame(rows, "pos int, want_mid long, want_rid long")


def fetch(table: LogTable, ids: DataFrame, fields: Fields | None = None) -> DataFrame:
    """(pos, id, doc) in the order of ids; doc is null for an unknown id.

    There are at most ``MOST`` ids, so they are broadcast, and their times bound the scan;
    more of them are an error.
    """
    own = ids.limit(MOST + 1).collect()
    if len(own) > MOST:
        raise RequestError(f"too many ids, at most {MOST}")
    times = [r["want_mid"] for r in own]
    ids = ids.sparkSession.createDataFrame(own, ids.schema)
    rows = table.rows.filter(table.within(min(times), max(times)) if times else F.lit(False))
    if "nested_path" in rows.columns:
        rows = rows.filter("nested_path IS NULL")
    own = rows.select(table.mid.alias("_mid"), table.rid.alias("_rid"), selected(F.col(table.doc), fields).alias("_doc"))
    found = own.join(F.broadcast(ids), (F.col("_mid") == F.col("want_mid")) & (F.col("_rid") == F.col("want_rid"))).groupBy("pos").agg(F.max_by("_doc", F.coalesce(F.length("_doc"), F.lit(0))).alias("doc"))
    return ids.join(found, "pos", "left").select("pos", id_text(F.col("want_mid"), F.col("want_rid")).alias("id"), "doc").orderBy("pos")


def export(table: LogTable, matching: DataFrame, size: int, offset: int = 0, fields: Fields | None = None) -> Iterator[str]:
    """Documents of a page one by one."""
    if size > MOST:
        raise RequestError(f"too many documents are requested, at most {MOST}")
    for row in page(table, matching, size, offset).select(selected(F.col(table.doc), fields).alias("doc")).toLocalIterator(prefetchPartitions=True):
        yield row.doc


def written_windows(spark, path: str) -> list[int]:
    """The windows that a folder has already."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[7:]) for n in found if n.startswith("window="))


def export_windows(table: LogTable, matching: DataFrame, path: str, window_ms: int, fields: Fields | None = None) -> None:
    """Writes all documents as gzipped lines, a folder for each window of time.

    Windows that exist are passed over, so that an export that was broken off goes on: a
    window's folder appears as a whole when its job is committed.
    """
    spark = matching.sparkSession
    window = floor_to(table.mid, window_ms).alias("window")
    done = spark.createDataFrame([(w,) for w in written_windows(spark, path)], "window long")
    out = matching.select(window, selected(F.col(table.doc), fields).alias("value")).join(done, "window", "left_anti")
    out.repartition("window", F.pmod(F.xxhash64("value"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("window").text(path)
