"""Aggregations: COUNT, SUM, MIN, MAX, AVG, QUANTILE and UNIQUE, by a key and by time.

Each result has the buckets (ts, name, value, not_exists and, for quantiles, all of them)
and the number of rows that have the field but no key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweir.functions.scalar import floor_to, number
from logweir.operators.search import RequestError
from logweir.operators.table import LogTable

FUNCTIONS = ("count", "sum", "min", "max", "avg", "quantile", "unique")
MISSING = "_not_exists"
#: Group keys, and values of the field, that an aggregation may have.
MOST_GROUPS, MOST_VALUES = 2000, 1_000_000
#: Buckets of all groups and times that one answer brings to the driver.
MOST_BUCKETS = 1_000_000
#: Parts of each doubling of a value among which exact quantiles are sought.
PARTS = 4096


@dataclass(frozen=True)
class Agg:
    func: str = "count"
    field: str = ""
    group_by: str = ""
    quantiles: tuple[float, ...] = ()
    interval_ms: int = 0
    #: Quantiles from a sketch of this accuracy instead of exact ones; 0: exact.
    accuracy: int = 0

    def check(self) -> None:
        if self.func not in FUNCTIONS:
            raise RequestError(f'unknown aggregation function "{self.func}"')
        if self.func == "count" and not (self.field or self.group_by):
            raise RequestError("'field' or 'group_by' must be set")
        if self.func == "unique":
            if not self.group_by:
                raise RequestError("'group_by' must be set")
            if self.interval_ms:
                raise RequestError("'interval' is not allowed for unique")
        if self.func not in ("count", "unique") and not self.field:
            raise RequestError("'field' must be set")
        if self.func == "quantile" and (not self.quantiles or not all(0 <= q <= 1 for q in self.quantiles)):
            raise RequestError("'quantiles' must hold numbers from 0 to 1")
        if self.interval_ms < 0:
            raise RequestError("'interval' must not be negative")


def _token(table: LogTable, title: str) -> Column:
    f = table.fields[title]
    if f.kind != "keyword":
        raise RequestError(f'field "{title}": only keywords can be aggregated')
    return f.column


def _value(table: LogTable, title: str) -> Column:
    """The field as a number; a value that is none fails the query."""
    f = table.fields[title]
    if f.native:
        return _token(table, title).cast("double")
    c = _token(table, title)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(number(c), F.raise_error(F.lit("parse errors reached")).cast("double")))


def _nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(float("nan")))


def part_of(value: Column) -> Column:
    """The part of all numbers that a value is in: parts are as wide as their values are large, and in their order.

    A heavy tail therefore takes no part of the values near its foot.
    """
    size = F.floor(F.log2(F.abs(value)) * PARTS) + F.lit(1100 * PARTS)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size).cast("long")


def quantiles(rows: DataFrame, keys: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """(keys, quantiles): for each q the value of rank int((n - 1) * q + 0.5), counted from 0, exactly.

    No key's values meet in one place: they are counted, value by value, before they are
    dealt; the counts of a key's parts show the part that holds each rank, and only the
    distinct values of that part are ranked.  Both sides of the join are such counts.
    """
    counts = rows.groupBy(*keys, part_of(F.col(value)).alias("_part"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_c"))
    whole = Window.partitionBy(*keys)
    parts = parts.withColumn("_upto", F.sum("_c").over(whole.orderBy("_part"))).withColumn("_n", F.sum("_c").over(whole))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor((F.col("_n") - 1) * F.lit(q) + F.lit(0.5)).alias("rank")) for i, q in enumerate(qs)])
    held = parts.withColumn("_q", F.explode(ranks))
    held = held.filter((F.col("_q.rank") < F.col("_upto")) & (F.col("_q.rank") >= F.col("_upto") - F.col("_c")))
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.col("_q.i").alias("_i"), (F.col("_q.rank") - F.col("_upto") + F.col("_c")).alias("_left"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = counts.hint("merge").join(held, on).withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_part", "_i").orderBy("_v")))
    found = near.filter((F.col("_left") < F.col("_to")) & (F.col("_left") >= F.col("_to") - F.col("_c")))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("quantiles"))


def estimated_quantiles(rows: DataFrame, keys: list[str], value: str, qs: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(keys, quantiles) from a sketch of bounded size for each key; ranks are off by n / accuracy at most."""
    return rows.groupBy(*keys).agg(F.percentile_approx(value, list(qs), accuracy).alias("quantiles"))


def buckets(table: LogTable, matching: DataFrame, agg: Agg) -> DataFrame:
    """(ts, name, value, not_exists, quantiles), unordered; ts is null without an interval."""
    agg.check()
    time = floor_to(table.mid, agg.interval_ms) if agg.interval_ms else F.lit(None).cast("long")
    none = F.lit(None).cast("array<double>").alias("quantiles")
    if agg.func == "count":
        key = _token(table, agg.field or agg.group_by).cast("string")
        rows = matching.select(time.alias("ts"), key.alias("name"))
        if agg.interval_ms:  # the bucket of rows without a key has no time, and goes
            rows = rows.filter("name IS NOT NULL")
        out = rows.groupBy("ts", F.coalesce("name", F.lit(MISSING)).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return out.select("ts", "name", "value", F.lit(0).cast("long").alias("not_exists"), none)
    if agg.func == "unique":
        key = _token(table, agg.group_by).cast("string")
        out = matching.select(key.alias("name")).filter("name IS NOT NULL").distinct()
        return out.select(time.alias("ts"), "name", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("not_exists"), none)
    value = _value(table, agg.field)
    if agg.group_by:
        rows = matching.select(time.alias("ts"), _token(table, agg.group_by).cast("string").alias("name"), value.alias("v")).filter("name IS NOT NULL")
        if agg.interval_ms:
            rows = rows.filter("v IS NOT NULL")
    else:
        rows = matching.select(time.alias("ts"), F.lit("").alias("name"), value.alias("v"))
    missing = F.count_if(F.col("v").isNull()).alias("not_exists")
    if agg.func == "quantile":
        sizes = rows.groupBy("ts", "name").agg(missing)
        own = rows.filter("v IS NOT NULL")
        found = estimated_quantiles(own, ["ts", "name"], "v", agg.quantiles, agg.accuracy) if agg.accuracy else quantiles(own, ["ts", "name"], "v", agg.quantiles)
        both = sizes.join(found, sizes["ts"].eqNullSafe(found["ts"]) & (sizes["name"] == found["name"]), "left")
        return both.select(sizes["ts"], sizes["name"], _nan(F.col("quantiles")[0]).alias("value"), "not_exists", "quantiles")
    made = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[agg.func]("v")
    return rows.groupBy("ts", "name").agg(_nan(made).alias("value"), missing).select("ts", "name", "value", "not_exists", none)


def not_exists(table: LogTable, matching: DataFrame, agg: Agg) -> DataFrame:
    """One row with the rows that have the field (any row, for COUNT and UNIQUE) but no key."""
    agg.check()
    if agg.func in ("count", "unique"):
        key = agg.group_by if agg.func == "unique" else agg.field or agg.group_by
        lost = _token(table, key).isNull()
    elif agg.group_by:
        lost = _token(table, agg.group_by).isNull() & _token(table, agg.field).isNotNull()
    else:
        lost = F.lit(False)
    return matching.agg(F.count_if(lost).alias("not_exists"))


def ordered(out: DataFrame, func: str) -> DataFrame:
    """Buckets in the order of answers; NaN is below all numbers."""
    v, nan = F.col("value"), F.isnan("value")
    if func == "min":
        return out.orderBy("ts", nan.desc(), v, "name")
    if func == "quantile":
        return out.orderBy("ts", "name", nan.asc(), v.desc())
    return out.orderBy("ts", nan.asc(), v.desc(), "name")


def check_values(table: LogTable, matching: DataFrame, title: str, most: int = MOST_VALUES) -> None:
    """Raises if the rows have more than ``most`` different values of a field."""
    if matching.select(_token(table, title).alias("t")).filter("t IS NOT NULL").distinct().limit(most + 1).count() > most:
        raise RequestError("too many unique values")


def answer(table: LogTable, matching: DataFrame, agg: Agg, most_groups: int = MOST_GROUPS, most_buckets: int = MOST_BUCKETS) -> tuple[list, int]:
    """(buckets in order, not_exists) as Python rows; too many groups or buckets are an error."""
    made = buckets(table, matching, agg)
    if agg.interval_ms:  # each task would send as many buckets as an answer may have
        sizes = made.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        groups = (sizes.filter(F.col("name") != MISSING).limit(most_groups + 1) if agg.group_by else sizes).agg(F.count(F.lit(1)).alias("groups")).first()["groups"]
        if groups > most_groups and agg.group_by or (sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) > most_buckets:
            raise RequestError("too many unique values")
    rows = ordered(made, agg.func)
    most = most_groups + 1 if agg.group_by and not agg.interval_ms else most_buckets
    got = rows.limit(most + 1).collect()
    if len(got) > most or len({r.name for r in got if r.name != MISSING}) > most_groups and agg.group_by:
        raise RequestError("too many unique values")
    return got, not_exists(table, matching, agg).first()["not_exists"]


def rendered(value: float) -> float | str:
    """A value as answers in JSON have it: what JSON has no number for is a string."""
    if value != value:
        return "NaN"
    return {float("inf"): "+Inf", float("-inf"): "-Inf"}.get(value, value)
