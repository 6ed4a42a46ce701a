"""Continuous ingest: a stream of documents to the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.sources import bulk, store
from logweir.sources.mapping import Mapping


def bodies(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (bulk, pos, doc, reason) of the request bodies that appear in a folder as files."""
    return bulk.requests(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True))


def lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (value) of the lines of the text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def stamped_once(docs: DataFrame, within: str = "1 hour", **times) -> DataFrame:
    """Stamped documents, of which each id passes once within the watermark: retried bulks add nothing.

    The state holds the ids of that time and no more.
    """
    return store.stamped(docs, **times).withWatermark("ts", within).dropDuplicatesWithinWatermark(["mid", "rid"])


def start(docs: DataFrame, mapping: Mapping, path: str, checkpoint: str, once: bool = False, within: str = "1 hour", **times) -> StreamingQuery:
    """Writes the index rows of a stream (doc, ...) to the table at ``path``; with ``once`` it ends when all is read.

    What is no JSON object is for ``start_rejected``.
    """
    fine = bulk.judged(docs).filter("reason IS NULL").drop("reason")
    rows = store.index_rows(stamped_once(fine, within, **times), mapping)
    return _started(store.with_day(rows).writeStream.partitionBy("dt"), path, checkpoint, once)


def start_rejected(docs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes what ``start`` leaves out of a stream, with the reason, to a table of its own."""
    bad = bulk.judged(docs).filter("reason IS NOT NULL").select("doc", "reason")
    return _started(bad.writeStream, path, checkpoint, once)


def _started(out, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    out = out.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()


def counted(docs: DataFrame, interval: str = "1 minute", within: str = "10 minutes", **times) -> DataFrame:
    """A stream of (begin, docs): documents by tumbling windows of event time, late ones within the watermark."""
    return store.stamped(docs, **times).withWatermark("ts", within).groupBy(F.window("ts", interval)).agg(F.count(F.lit(1)).alias("docs")).select(F.col("window.start").alias("begin"), "docs")
