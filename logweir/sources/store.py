"""The stored table: documents to index rows to Parquet by day, and back.

Columns: mid, rid, ts, doc, size, dt; ``has`` (titles that the row has); ``nested_path``
and ``nested_pos`` of rows of nested elements; one ``f_<title>`` for each searched field:
a string for a keyword, tokens for text and paths (and ``w_<title>``, the path itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweir.functions import text
from logweir.functions.scalar import TIME_FIELDS, clamped, mid_of, parsed_time
from logweir.operators.table import LogTable
from logweir.plans.compile import Column_, Fields
from logweir.sources.mapping import Field, Mapping


_MAP = "map<string,string>"


def _value(at: Column, key: str) -> Column:
    """The text of a key's value, strings as they are and others as JSON; null is ``null``."""
    v = F.try_element_at(at, F.lit(key))
    return F.coalesce(v, F.when(F.map_contains_key(at, F.lit(key)), F.lit("null")))


def _dig(at: Column, name: str, objects: dict[str, Column]) -> Column:
    """The text at a dotted name: dots are levels or part of the keys; objects: those that are parsed already."""
    out = [_value(at, name)]
    keys = name.split(".")
    for i in range(len(keys) - 1, 0, -1):
        head = ".".join(keys[:i])
        inner = objects[head] if head in objects else F.from_json(F.try_element_at(at, F.lit(head)), _MAP)
        out.append(_value(inner, ".".join(keys[i:])))
    return F.coalesce(*out)


def _element_name(f: Field) -> str:
    return f.name[len(f.parent) + 1 :]


def column_of(f: Field, value: Column, partial: bool, exact: bool, token_bytes: int, text_bytes: int) -> Column | None:
    if f.kind == "keyword":
        return text.keyword(value, f.size or token_bytes, partial, exact)
    if f.kind == "text":
        return text.words(value, f.size or text_bytes, token_bytes, partial, exact)
    if f.kind == "path":
        return text.prefixes(value, f.size or token_bytes, partial, exact)
    return None


def _tag(entries: Column, key: str) -> tuple[Column, Column]:
    """(value, presence) of a key in an array of {key, value}."""
    found = F.filter(entries, lambda x: F.try_element_at(x, F.lit("key")) == key)
    return _value(F.get(found, 0), "value"), F.coalesce(F.size(found) > 0, F.lit(False))


def index_rows(docs: DataFrame, mapping: Mapping, partial: bool = False, case_sensitive: bool = False, token_bytes: int = 72, text_bytes: int = 32768) -> DataFrame:
    """Index rows of (mid, rid, ts, doc): one for each document and for each element of a nested array.

    A nested row has the fields of its document too.
    """
    rows = _once(docs, {"_json": F.from_json("doc", _MAP)})
    own = [f for f in mapping.searched() if f.parent_kind != "nested"]
    tags = mapping.of_kind("tags")
    lists = [f for f in mapping.of_kind("nested") if f.parent_kind != "nested"]

    def columns(f: Field, value: Column, there: Column) -> dict[str, Column]:
        made = column_of(f, value, partial, case_sensitive, token_bytes, text_bytes)
        out = {f"e_{f.title}": there}
        if made is not None:
            out[f"f_{f.title}"] = made
        if f.kind == "path":
            out[f"w_{f.title}"] = F.when(F.octet_length(value) <= (f.size or token_bytes), text.folded(value, case_sensitive))
        return out

    parsed = {f"_o_{f.name}": F.from_json(_dig(F.col("_json"), f.name, {}), _MAP) for f in mapping.of_kind("object") if f.parent_kind != "nested"}
    parsed |= {f"_t_{f.name}": F.from_json(_dig(F.col("_json"), f.name, {}), f"array<{_MAP}>") for f in tags if f.parent_kind != "nested"}
    rows = _once(rows, parsed)
    objects = {c[3:]: F.col(f"`{c}`") for c in parsed if c.startswith("_o_")}

    made: dict[str, Column] = {}
    for f in own:
        parent = next((t for t in tags if f.name.startswith(t.name + ".") and t.parent_kind != "nested"), None)
        if parent:
            made |= columns(f, *_tag(F.col(f"`_t_{parent.name}`"), f.name[len(parent.name) + 1 :]))
        else:
            made[f"v_{f.title}"] = _dig(F.col("_json"), f.name, objects)
    values = [c for c in made if c.startswith("v_")]
    rows = _once(rows, {c: made.pop(c) for c in values})
    for f in own:
        if f"v_{f.title}" in values:
            v = F.col(f"`v_{f.title}`")
            made |= columns(f, v, v.isNotNull())
    rows = rows.withColumns(made | {"size": F.octet_length("doc")}) if not lists else _once(rows, made | {"size": F.octet_length("doc")})
    nothing = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast(_MAP).alias("element"))
    elements = [F.array(nothing)]
    for n in lists:
        found = F.coalesce(F.from_json(_dig(F.col("_json"), n.name, objects), f"array<{_MAP}>"), F.array().cast(f"array<{_MAP}>"))
        elements.append(F.transform(found, _placed(n.title)))
    rows = rows.withColumn("_each", F.explode(F.concat(*elements))) if lists else rows.withColumn("_each", nothing)
    inner: dict[str, Column] = {"nested_path": F.col("_each.path"), "nested_pos": F.col("_each.pos")}
    for n in lists:
        here = F.when(F.col("_each.path") == n.title, F.col("_each.element"))
        for f in mapping.searched():
            if f.parent == n.name and f.parent_kind == "nested":
                v = _dig(here, _element_name(f), {})
                inner |= columns(f, v, v.isNotNull())
    flags = [c for c in [*made, *inner] if c.startswith("e_")]
    rows = rows.withColumns(inner)
    if lists:
        rows = rows.withColumn("size", F.when(F.col("nested_path").isNull(), F.col("size")).otherwise(F.lit(0)))
    has = F.array(*[F.when(F.col(f"`{c}`"), F.lit(c[2:])) for c in flags]) if flags else F.array().cast("array<string>")
    return rows.withColumn("has", F.array_compact(has)).drop("_json", "_each", *parsed, *values, *flags)


def _placed(title: str):
    return lambda x, i: F.struct(F.lit(title).alias("path"), i.cast("int").alias("pos"), x.alias("element"))


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that are computed once for each row, however often and by whatever filter they are used.

    Plain columns would be put in the place of every use of theirs, JSON parsing and all;
    nothing is moved through a generator.
    """
    if not columns:
        return rows
    own = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = rows.withColumn("_own", F.explode(F.array(own)))
    return out.withColumns({n: F.col("_own")[n] for n in columns}).drop("_own")


def stamped(docs: DataFrame, arrival: Column | None = None, drift_ms: int = 86_400_000, future_ms: int = 300_000) -> DataFrame:
    """(mid, rid, ts, doc) of (doc) or (bulk, pos, doc): the event's time, clamped to the arrival, and an id.

    The id is fixed by the request, the place in it and the document: equal lines of a
    request are different documents, and a retried request adds nothing.  Documents that
    come without a request are known by their text alone.
    """
    arrival = F.current_timestamp() if arrival is None else arrival
    found = F.json_tuple("doc", *TIME_FIELDS).alias(*[f"_t{i}" for i in range(len(TIME_FIELDS))])
    whole = [c for c in ("bulk", "pos") if c in docs.columns]
    event = F.coalesce(*[parsed_time(F.col(f"_t{i}")) for i in range(len(TIME_FIELDS))])
    out = docs.select("doc", *whole, found).withColumn("_at", mid_of(arrival)).withColumn("mid", clamped(mid_of(event), F.col("_at"), drift_ms, future_ms))
    rid = F.xxhash64(*whole, "doc").bitwiseAND(F.lit(2**63 - 1))
    return out.withColumn("rid", rid).withColumn("ts", F.timestamp_millis("mid")).select("mid", "rid", "ts", "doc")


def delays(docs: DataFrame, arrival: Column, drift_ms: int = 86_400_000, future_ms: int = 300_000) -> DataFrame:
    """Counts of late, future and unreadable event times."""
    at, event = mid_of(arrival), mid_of(F.coalesce(*[parsed_time(F.get_json_object("doc", f"$.{f}")) for f in TIME_FIELDS]))
    return docs.agg(F.count_if(event < at - drift_ms).alias("delay"), F.count_if(event > at + future_ms).alias("future_delay"), F.count_if(event.isNull()).alias("parse_error"))


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dt", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("mid") / 86_400_000).cast("int")))


def dealt(docs: DataFrame) -> DataFrame:
    """Stamped documents dealt by day, large days in several parts: a part has the session's advisory size, however the input is split.

    Few rows are dealt as documents, before index rows are made of them.
    """
    return with_day(docs).hint("rebalance", "dt").drop("dt")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Index rows as Parquet by day."""
    with_day(rows).write.mode(mode).partitionBy("dt").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, path: str, target: str, only: list[str] | None = None, file_bytes: int = 32 << 20, job_bytes: int = 4 << 30) -> list[str]:
    """Writes days of the table anew without repeated rows, newest first within files; the days that were written.

    A job takes days of ``job_bytes`` together, one at least: nothing but their rows is
    dealt, once, by ranges of time over as many files as their bytes ask for, and other
    days of the target stay as they are.  Repeated rows are neighbours in the order of a
    file.  ``only``: the days to look at, all if None.
    """
    jobs: list[tuple[list[str], int]] = []
    for day, size in days(spark, path):
        if only is not None and day not in only:
            continue
        if jobs and jobs[-1][1] + size <= job_bytes:
            jobs[-1] = (jobs[-1][0] + [day], jobs[-1][1] + size)
        else:
            jobs.append(([day], size))
    for own, size in jobs:
        rows = spark.read.parquet(path).filter(F.col("dt").isin(*[F.lit(d).cast("date") for d in own]))
        rows = rows.withColumns({"_mid": -F.col("mid"), "_rid": -F.col("rid")}).repartitionByRange(max(len(own), -(-size // file_bytes)), "dt", "_mid", "_rid")
        # the window asks for no other dealing, and its order is that of the file
        turn = F.row_number().over(Window.partitionBy("dt", "_mid", "_rid", "nested_path", "nested_pos").orderBy("_mid"))
        out = rows.withColumn("_turn", turn).filter("_turn = 1").drop("_mid", "_rid", "_turn")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").option("compression", "zstd").parquet(target)
    return [d for own, _ in jobs for d in own]


def days(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(day, bytes) of the table's partitions, oldest first."""
    jvm, sc = spark._jvm, spark.sparkContext
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("dt=")]
    return sorted((p.getName()[3:], fs.getContentSummary(p).getLength()) for p in found)


def retain(spark: SparkSession, path: str, most_bytes: int) -> list[str]:
    """Drops the oldest days while the table is larger than ``most_bytes``; the newest day stays."""
    own = days(spark, path)
    total, gone = sum(n for _, n in own), []
    jvm, sc = spark._jvm, spark.sparkContext
    for day, n in own[:-1]:
        if total <= most_bytes:
            break
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        total -= n
        gone.append(day)
    return gone


def table(rows: DataFrame, mapping: Mapping) -> LogTable:
    """The log table over index rows, stored or just made."""
    columns = {}
    for f in mapping.searched():
        present = F.array_contains("has", f.title)
        if f.kind == "exists":
            columns[f.title] = Column_("exists", present)
        else:
            whole = F.col(f"`w_{f.title}`") if f.kind == "path" else None
            columns[f.title] = Column_(f.kind, F.col(f"`f_{f.title}`"), whole=whole, present=present)
    day = F.col("dt") if "dt" in rows.columns else None
    return LogTable(rows, Fields(columns, F.col("has")), F.col("mid"), F.col("rid"), mapping, day=day)


def read(spark: SparkSession, path: str, mapping: Mapping) -> LogTable:
    return table(spark.read.parquet(path), mapping)
