"""Inspection of a table: tokens, their rows, and the distribution of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.scalar import floor_to
from logweir.operators.table import LogTable


def tokens(table: LogTable, title: str) -> DataFrame:
    """(token, docs): rows that have each token of a field."""
    f = table.fields[title]
    each = F.explode(F.array_distinct(f.column)) if f.kind in ("text", "path") else f.column.cast("string")
    return table.rows.select(each.alias("token")).filter("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


def cardinality(table: LogTable, title: str) -> DataFrame:
    """One row: distinct tokens of a field, the rows of all of them, and of the most frequent one."""
    return tokens(table, title).agg(F.count(F.lit(1)).alias("tokens"), F.sum("docs").alias("postings"), F.max("docs").alias("largest"))


def minutes(table: LogTable) -> DataFrame:
    """(minute, docs): rows by minute."""
    return table.rows.groupBy(floor_to(table.mid, 60_000).alias("minute")).agg(F.count(F.lit(1)).alias("docs"))
