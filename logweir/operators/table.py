"""A log table: a DataFrame of index rows with its time, its order and its fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.plans import compile as plan
from logweir.plans import legacy, pipe
from logweir.plans.ast import Query
from logweir.sources.mapping import AUTO, Mapping

_EPOCH = datetime(1970, 1, 1)


@dataclass
class LogTable:
    """rows: one for each document and nested element; mid: ms since 1970; rid: what orders equal times.

    stamp: a timestamp without zone that can be pruned by; day: a date to prune partitions by.
    doc: the column with the document's text.
    """

    rows: DataFrame
    fields: plan.Fields
    mid: Column
    rid: Column
    mapping: Mapping = field(default_factory=lambda: AUTO)
    stamp: Column | None = None
    day: Column | None = None
    doc: str = "doc"

    def within(self, begin: int | None, end: int | None) -> Column:
        """Rows from begin to end, both in ms and included."""
        out = F.lit(True)
        if self.stamp is not None:
            at = lambda ms: F.lit((_EPOCH + timedelta(milliseconds=ms)).isoformat(sep=" ")).cast("timestamp_ntz")
            if begin is not None:
                out &= self.stamp >= at(begin)
            if end is not None:
                out &= self.stamp < at(end + 1)
            return out
        for ms, over in ((begin, True), (end, False)):
            if ms is None:
                continue
            out &= self.mid >= F.lit(ms) if over else self.mid <= F.lit(ms)
            if self.day is not None:
                day = F.lit((_EPOCH + timedelta(milliseconds=ms)).date())
                out &= self.day >= day if over else self.day <= day
        return out

    def parse(self, query: str, dialect: str = "pipe", case_sensitive: bool = False) -> Query:
        if dialect == "pipe":
            return pipe.parse(query, self.mapping, case_sensitive)
        if dialect == "legacy":
            return legacy.parse(query or "_all_:*", self.mapping, case_sensitive)
        raise ValueError(f'unknown dialect "{dialect}"')

    def select(self, query: str | Query = "*", begin: int | None = None, end: int | None = None, dialect: str = "pipe") -> DataFrame:
        """The index rows that a query selects."""
        tree = self.parse(query, dialect) if isinstance(query, str) else query
        return self.rows.filter(self.within(begin, end) & plan.condition(tree, self.fields))

    def union(self, other: LogTable, split: int) -> DataFrame:
        """Rows of this (hot) table from ``split`` ms on, and of the other (cold) one before."""
        return self.rows.filter(self.within(split, None)).unionByName(other.rows.filter(other.within(None, split - 1)), allowMissingColumns=True)
