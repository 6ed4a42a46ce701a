"""The calls of the search service over a log table."""

from __future__ import annotations

import contextlib
import io
import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.scalar import id_text
from logweir.jobs import Jobs
from logweir.operators import aggregate, search
from logweir.operators.aggregate import Agg
from logweir.operators.search import RequestError
from logweir.operators.table import LogTable
from logweir.plans.ast import Fields


@dataclass
class Answer:
    """docs: (id, doc) in order; total: matching rows if asked for, else 0; hist: bucket to count; aggs: (buckets, not_exists)."""

    docs: list[tuple[str, str]] = field(default_factory=list)
    total: int = 0
    hist: dict[int, int] = field(default_factory=dict)
    aggs: list[tuple[list, int]] = field(default_factory=list)
    explain: str = ""

    def to_json(self) -> str:
        """The answer as the service sends it; numbers that JSON lacks are strings."""
        aggs = [{"buckets": [{"key": b.name, "value": aggregate.rendered(b.value), "notExists": b.not_exists} | ({"ts": b.ts} if b.ts is not None else {}) | ({"quantiles": [aggregate.rendered(x) for x in b.quantiles]} if b.quantiles else {}) for b in buckets], "notExists": lost} for buckets, lost in self.aggs]
        return json.dumps({"total": self.total, "docs": [{"id": i, "data": d} for i, d in self.docs], "hist": {str(k): v for k, v in sorted(self.hist.items())}, "aggs": aggs})


class Engine:
    def __init__(self, spark: SparkSession, table: LogTable, jobs_path: str = ""):
        self.spark, self.table = spark, table
        self.jobs = Jobs(spark, table, jobs_path) if jobs_path else None

    def rows(self, query: str = "*", begin: int | None = None, end: int | None = None, dialect: str = "pipe") -> DataFrame:
        return self.table.select(query, begin, end, dialect)

    def complex_search(self, query: str = "*", begin: int | None = None, end: int | None = None, size: int = 0, offset: int = 0, ascending: bool = False, with_total: bool = False, aggs: Iterable[Agg] = (), interval_ms: int = 0, dialect: str = "pipe", explain: bool = False) -> Answer:
        """Documents, total, histogram and aggregations of one query."""
        aggs = list(aggs)
        if size <= 0 and not aggs and not interval_ms and not with_total:
            raise RequestError("one of 'size', 'hist' or 'aggs' must be set")
        for a in aggs:
            a.check()
        began = time.time()
        tree = self.table.parse(query, dialect)
        rows = self.table.select(tree, begin, end)
        out = Answer()
        if size > 0:
            own = search.page(self.table, rows, size, offset, ascending)
            shown = own.select(id_text(self.table.mid, self.table.rid).alias("id"), search.selected(F.col(self.table.doc), tree.fields).alias("doc"))
            out.docs = [(r.id, r.doc) for r in shown.collect()]
            if explain:
                said = io.StringIO()
                with contextlib.redirect_stdout(said):
                    shown.explain("formatted")
                out.explain = said.getvalue()
        if interval_ms:
            got = search.histogram(self.table, rows, interval_ms).limit(aggregate.MOST_BUCKETS + 1).collect()
            if len(got) > aggregate.MOST_BUCKETS:
                raise RequestError("too many buckets")
            out.hist = {r.bucket: r.docs for r in got}
        if with_total:
            out.total = sum(out.hist.values()) if interval_ms else rows.count()
        out.aggs = [aggregate.answer(self.table, rows, a) for a in aggs]
        if explain:
            out.explain = f"{(time.time() - began) * 1000:.0f} ms\n{out.explain}"
        return out

    def search(self, query: str = "*", begin: int | None = None, end: int | None = None, size: int = 100, offset: int = 0, ascending: bool = False, with_total: bool = False, dialect: str = "pipe") -> Answer:
        if size <= 0:
            raise RequestError("'size' must be positive")
        return self.complex_search(query, begin, end, size, offset, ascending, with_total, dialect=dialect)

    def aggregate(self, query: str, aggs: Iterable[Agg], begin: int | None = None, end: int | None = None, dialect: str = "pipe") -> list[tuple[list, int]]:
        if not (own := list(aggs)):
            raise RequestError("'aggs' must be set")
        return self.complex_search(query, begin, end, aggs=own, dialect=dialect).aggs

    def histogram(self, query: str, interval_ms: int, begin: int | None = None, end: int | None = None, dialect: str = "pipe") -> dict[int, int]:
        if interval_ms <= 0:
            raise RequestError("'hist' must be set")
        return self.complex_search(query, begin, end, interval_ms=interval_ms, dialect=dialect).hist

    def fetch(self, ids: Iterable[str], fields: Iterable[str] = (), allow: bool = True) -> Iterator[tuple[str, str]]:
        """(id, doc) in the order of ids; an unknown id has an empty document."""
        names = tuple(fields)
        chosen = Fields(names, not allow) if names else None
        for r in search.fetch(self.table, search.wanted(self.spark, ids), chosen).toLocalIterator():
            yield r.id, r.doc or ""

    def export(self, query: str, size: int, begin: int | None = None, end: int | None = None, offset: int = 0, dialect: str = "pipe") -> Iterator[str]:
        tree = self.table.parse(query, dialect)
        return search.export(self.table, self.table.select(tree, begin, end), size, offset, tree.fields)

    def mapping(self) -> str:
        return self.table.mapping.to_json()

    def status(self) -> dict:
        """The oldest and newest time and the number of rows."""
        r = self.table.rows.agg(F.min(self.table.mid).alias("oldest"), F.max(self.table.mid).alias("newest"), F.count(F.lit(1)).alias("rows")).first()
        return r.asDict()
