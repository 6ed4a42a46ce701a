"""Registered queries of the stored table, the service's calls, errors and streams, with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir import queries as q
from logweir import scratch
from logweir.engine import Answer, Engine
from logweir.functions import scalar
from logweir.operators import aggregate, search
from logweir.operators.aggregate import Agg
from logweir.operators.table import LogTable
from logweir.plans import legacy, pipe
from logweir.plans.ast import dump
from logweir.plans.compile import Column_
from logweir.sources import bulk, store
from logweir.sources.mapping import from_dict
from logweir.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY, MID = q.DAY, q.MID


def _add(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLE_SQL[name] = make, sql


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _constant(name: str, columns: str, rows: Callable[[], list[tuple]], want: list[tuple]) -> None:
    """A query whose rows depend on no table: what the plans and functions make of fixed values."""
    cells = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else _text(x) for x in r) + ")" for r in want)
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    _add(name, f"SELECT * FROM (VALUES {cells}) AS t({names})", lambda s, d: s.createDataFrame(rows(), columns))


def arrival():
    return F.lit("2024-02-01T00:00:00Z").cast("timestamp")


def bodies(s: SparkSession, d: str, numbered: bool = True) -> DataFrame:
    """(value): request bodies of at most 100 events each, with a line that is no object and one that is no JSON; each twentieth lacks its first action."""
    rows = q._read(s, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp")
    doc = F.to_json(F.struct(stamp, F.lower("event_type").alias("kind"), F.struct(F.col("user_id").alias("id")).alias("user"), *[F.col("event_id").alias("n")] * numbered))
    pairs = rows.select(F.floor(F.col("event_id") / 100).alias("g"), "event_id", F.concat(F.lit('{"index":{}}\n'), doc).alias("pair"))
    joined = pairs.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "pair"))), lambda x: x["pair"]), "\n").alias("own"))
    odd = F.lit('\n{"create":{}}\n[1, 2]\n\n{"index":{"_index":"x"}}\n{"kind": \n')
    return joined.select(F.concat(F.when(F.col("g") % 20 == 7, F.lit('{"kind":"early"}\n{}\n')).otherwise(F.lit("")), "own", odd).alias("value"))


_FINE = "event_id // 100 % 20 <> 7"
_add("s_bulk", f"SELECT event_id AS n, lower(event_type) AS kind FROM events WHERE {_FINE}", lambda s, d: bulk.split_valid(bulk.requests(bodies(s, d)))[0].select(F.get_json_object("doc", "$.n").cast("long").alias("n"), F.get_json_object("doc", "$.kind").alias("kind")))
_add(
    "s_quarantine",
    f"WITH g AS (SELECT DISTINCT event_id // 100 AS g FROM events) SELECT 'unexpected action line' AS reason, count(*) AS docs FROM g WHERE g % 20 = 7 UNION ALL SELECT r, count(*) FROM g, (VALUES ('not an object'), ('invalid JSON')) AS t(r) WHERE g % 20 <> 7 GROUP BY 1",
    lambda s, d: bulk.split_valid(bulk.requests(bodies(s, d)))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("docs")),
)


def _ids(s: SparkSession, d: str) -> DataFrame:
    """Lines of which many are equal, each request sent twice: retries have the ids of the first time, equal lines have their own."""
    sent = bodies(s, d, numbered=False)
    rows = store.stamped(bulk.split_valid(bulk.requests(sent.unionByName(sent)))[0], arrival(), drift_ms=40 * DAY)
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("mid", "rid").alias("ids"))


_add("s_ids", f"SELECT 2 * count(*) AS lines, count(*) AS ids FROM events WHERE {_FINE}", _ids)


def stored(s: SparkSession, d: str, times: int = 1) -> tuple[str, object]:
    """Events, through the whole way of ingest, as a stored table; with ``times`` 2 each bulk was sent twice."""
    path, mapping = scratch.folder(s, "table"), from_dict(q._SPEC)
    for _ in range(times):
        store.write(store.index_rows(store.dealt(q.sent_events(s, d)), mapping), path)
    return path, mapping


def _stored(query: str, begin: int | None = None, end: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def make(s: SparkSession, d: str) -> DataFrame:
        rows = store.read(s, *stored(s, d)).select(query, begin, end)
        return rows.filter("nested_path IS NULL").select(F.get_json_object("doc", "$.n").cast("long").alias("n"), "mid")

    return make


_add("s_store", f"SELECT event_id AS n, {MID} AS mid FROM events WHERE event_type = 'error' AND user_id > 100", _stored("kind:error and _exists_:seen"))
_add("s_store_text", f"SELECT event_id AS n, {MID} AS mid FROM events WHERE event_type = 'view' AND user_id <> 8", _stored('note:"VIEW event" and not user.id:8'))
_add("s_store_time", f"SELECT event_id AS n, {MID} AS mid FROM events WHERE {MID} BETWEEN {q.BEGIN} AND {q.END} AND value >= 50", _stored("value:[50, *]", q.BEGIN, q.END))
_add("s_store_days", "SELECT CAST(ts AS DATE) AS dt, 3 * count(*) AS rows_ FROM events GROUP BY 1", lambda s, d: s.read.parquet(stored(s, d)[0]).groupBy("dt").agg(F.count(F.lit(1)).alias("rows_")))


def _compacted(s: SparkSession, d: str) -> DataFrame:
    path, mapping = stored(s, d, times=2)
    target = scratch.folder(s, "compact")
    store.compact(s, path, target)
    t = store.read(s, target, mapping)
    return aggregate.buckets(t, t.select(), Agg("count", group_by="kind")).select("name", "value")


_add("s_compact", "SELECT event_type AS name, CAST(3 * count(*) AS DOUBLE) AS value FROM events GROUP BY 1", _compacted)


def _twice(s: SparkSession, d: str) -> DataFrame:
    t = store.read(s, *stored(s, d, times=2))
    return search.page(t, t.select("kind:error"), 200, 10).select(F.get_json_object("doc", "$.n").cast("long").alias("n"), "mid").groupBy("n", "mid").agg(F.count(F.lit(1)).alias("times"))


_add("s_page_of_retried", f"SELECT event_id AS n, mid, 1 AS times FROM (SELECT event_id, {MID} AS mid, lag({MID}) OVER w AS before, lead({MID}) OVER w AS after FROM events WHERE event_type = 'error' WINDOW w AS (ORDER BY {MID} DESC)) ORDER BY mid DESC LIMIT 200 OFFSET 10", _twice)


def _recent(s: SparkSession, d: str) -> DataFrame:
    path, mapping = stored(s, d)
    t = store.read(s, path, mapping)
    got = search.recent(t, t.select("kind:error and value:[60, *]").filter("nested_path IS NULL"), 40, [day for day, _ in store.days(s, path)])
    return s.createDataFrame(got, t.rows.schema).select("mid", F.get_json_object("doc", "$.kind").alias("kind"))


_add("o_recent", f"SELECT {MID} AS mid, 'ERROR' AS kind FROM events WHERE event_type = 'error' AND value >= 60 ORDER BY mid DESC LIMIT 40", _recent)


def _retained(s: SparkSession, d: str) -> DataFrame:
    path, _ = stored(s, d)
    gone = store.retain(s, path, 0)
    return s.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("rows_")).withColumn("gone", F.lit(len(gone)).cast("long"))


_add("s_retain", "WITH x AS (SELECT CAST(ts AS DATE) AS dt, 3 * count(*) AS rows_ FROM events GROUP BY 1) SELECT dt, rows_, (SELECT count(*) - 1 FROM x) AS gone FROM x WHERE dt = (SELECT max(dt) FROM x)", _retained)


def _delays(s: SparkSession, d: str) -> DataFrame:
    docs = q._read(s, d, "events").select(F.to_json(F.struct(F.when(F.col("user_id") != 8, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("yesterday").alias("time"))).alias("doc"))
    return store.delays(docs, F.timestamp_millis(F.lit(q.END)))


_add("s_delays", f"SELECT count(*) FILTER (user_id <> 8 AND {MID} < {q.END} - {DAY}) AS delay, count(*) FILTER (user_id <> 8 AND {MID} > {q.END} + 300000) AS future_delay, count(*) FILTER (user_id = 8) AS parse_error FROM events", _delays)


def _exported(s: SparkSession, d: str) -> DataFrame:
    """An export that was broken off after its first window, and done again."""
    t, path = q.events(s, d), scratch.folder(s, "export")
    search.export_windows(t, t.select("event_type:error", None, q.BEGIN), path, DAY)
    first = len(search.written_windows(s, path))
    search.export_windows(t, t.select("event_type:error", q.BEGIN - q.BEGIN % DAY + DAY), path, DAY)
    return s.read.text(path).groupBy("window").agg(F.count(F.lit(1)).alias("docs")).select(F.col("window").cast("long").alias("window"), "docs", (F.lit(first) > 0).alias("resumed"))


_CUT = q.BEGIN - q.BEGIN % DAY + DAY
_add("s_export", f"SELECT {q._T} AS window, count(*) AS docs, true AS resumed FROM events WHERE event_type = 'error' AND ({MID} <= {q.BEGIN} OR {MID} >= {_CUT}) GROUP BY 1", _exported)


def _same_id(s: SparkSession, d: str) -> DataFrame:
    t = q.events(s, d)
    ids = search.page(t, t.select("event_type:click"), 40, ascending=True).select(F.lit(0).alias("pos"), t.mid.alias("want_mid"), F.col("event_id").alias("want_rid")).withColumn("pos", (F.col("want_rid") % 2**31).cast("int"))
    t.rows = t.rows.unionByName(t.rows)
    return search.fetch(t, ids).select("id", F.get_json_object("doc", "$.k").alias("k"))


_add("l_same_id", f"SELECT {q._ID} AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' ORDER BY {MID}, event_id LIMIT 40", _same_id)


def _engine(s: SparkSession, d: str) -> Engine:
    return Engine(s, q.events(s, d), scratch.folder(s, "jobs"))


def _answered(name: str, columns: str, sql: str, rows: Callable[[Engine], list[tuple]]) -> None:
    _add(name, sql, lambda s, d: s.createDataFrame(rows(_engine(s, d)), columns))


_PLACE = f"row_number() OVER (ORDER BY {MID} DESC, event_id DESC) - 1 AS pos"
_answered("c_search", "pos long, id string", f"SELECT {_PLACE}, {q._ID} AS id FROM events WHERE event_type = 'error' AND value > 50 ORDER BY pos LIMIT 30", lambda e: [(i, x) for i, (x, _) in enumerate(e.search("event_type:error and value:(50, *]", size=30).docs)])
_answered("c_total", "total long, docs long", "SELECT count(*) AS total, 5 AS docs FROM events WHERE event_type = 'error'", lambda e: [((a := e.search("event_type:error", size=5, with_total=True)).total, len(a.docs))])
_answered("c_histogram", "bucket long, docs long", f"SELECT {q._T} AS bucket, count(*) AS docs FROM events WHERE user_id = 8 GROUP BY 1", lambda e: list(e.histogram("user_id:8", DAY).items()))
_answered(
    "c_complex", "what string, name string, value double",
    "SELECT 'count' AS what, event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events WHERE user_id < 50 GROUP BY 2 UNION ALL SELECT 'max', event_type, round(max(value), 4) FROM events WHERE user_id < 50 GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM events WHERE user_id < 50 UNION ALL SELECT 'hist', '', count(*) FROM events WHERE user_id < 50",
    lambda e: (lambda a: [("count", b.name, b.value) for b in a.aggs[0][0]] + [("max", b.name, round(b.value, 4)) for b in a.aggs[1][0]] + [("total", "", float(a.total)), ("hist", "", float(sum(a.hist.values())))])(e.complex_search("user_id:[*, 50)", size=3, aggs=[Agg("count", group_by="event_type"), Agg("max", "value", "event_type")], interval_ms=DAY, with_total=True)),
)
_answered("c_fetch", "pos long, k string, other string", f"SELECT {_PLACE}, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS other FROM events WHERE event_type = 'view' ORDER BY pos LIMIT 20", lambda e: [(i, str((doc := json.loads(x))["k"]), doc.get("other")) for i, (_, x) in enumerate(e.fetch([i for i, _ in e.search("event_type:view", size=20).docs], ["k"]))])
_answered("c_export", "k string, times long", f"SELECT json_extract_string(props, '$.k') AS k, count(*) AS times FROM (SELECT props FROM events WHERE event_type = 'signup' OR event_type = 'error' ORDER BY {MID} DESC, event_id DESC LIMIT 300) GROUP BY 1", lambda e: list(Counter(str(json.loads(x)["k"]) for x in e.export("event_type:in(signup, error)", 300)).items()))
_answered("c_mapping", "field string, kind string", "SELECT * FROM (VALUES ('event_type', 'keyword'), ('user_id', 'keyword'), ('value', 'keyword'), ('props.k', 'keyword')) AS t(field, kind)", lambda e: list(json.loads(e.mapping()).items()))
_answered("c_status", "oldest long, newest long, rows_ long", f"SELECT min({MID}) AS oldest, max({MID}) AS newest, count(*) AS rows_ FROM events", lambda e: [tuple(e.status().values())])


def _background(s: SparkSession, d: str) -> DataFrame:
    """A search in the background, read by another session than the one that has started it."""
    e = _engine(s, d)
    id_ = e.jobs.start("event_type:error", size=25, aggs=[Agg("sum", "value", "event_type")], interval_ms=DAY)
    e.jobs.wait(id_, 600)
    other = Engine(s, e.table, e.jobs.root).jobs
    hist = other.result(id_, "hist").agg(F.sum("docs").cast("double").alias("value")).withColumn("what", F.lit("hist"))
    aggs = other.result(id_, "agg0").select(F.round("value", 2).alias("value"), F.lit("sum").alias("what"))
    docs = other.result(id_, "docs").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("what", F.lit("docs"))
    return hist.unionByName(aggs).unionByName(docs).select("what", "value")


_add("c_background", "SELECT 'hist' AS what, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type = 'error' UNION ALL SELECT 'sum', round(sum(value), 2) FROM events WHERE event_type = 'error' UNION ALL SELECT 'docs', 25.0", _background)


def _placed(agg: Agg) -> Callable[[SparkSession, str], DataFrame]:
    """Buckets in the order of answers, with their places."""

    def make(s: SparkSession, d: str) -> DataFrame:
        t = q.events(s, d)
        got, _ = aggregate.answer(t, t.select("user_id:[*, 20]"), agg)
        return s.createDataFrame([(i, b.name) for i, b in enumerate(got)], "place long, name string")

    return make


_U = "(SELECT CAST(user_id AS VARCHAR) AS name, {f} AS v FROM events WHERE user_id <= 20 GROUP BY 1)"
_add("a_order_sum", f"SELECT row_number() OVER (ORDER BY v DESC, name) - 1 AS place, name FROM {_U.format(f='sum(value)')}", _placed(Agg("sum", "value", "user_id")))
_add("a_order_min", f"SELECT row_number() OVER (ORDER BY v, name) - 1 AS place, name FROM {_U.format(f='min(value)')}", _placed(Agg("min", "value", "user_id")))
_add("a_order_count", f"SELECT row_number() OVER (ORDER BY v DESC, name) - 1 AS place, name FROM {_U.format(f='count(*)')}", _placed(Agg("count", group_by="user_id")))
_add("a_order_quantile", f"SELECT row_number() OVER (ORDER BY name) - 1 AS place, name FROM {_U.format(f='1')}", _placed(Agg("quantile", "value", "user_id", (0.5,))))


def _no_values(s: SparkSession, d: str) -> DataFrame:
    t = q.documents(s, d)
    return aggregate.buckets(t, t.select("not _exists_:toxic"), Agg("max", "toxic", "source")).select("name", F.isnan("value").alias("is_nan"), "not_exists")


_add("a_no_values", f"SELECT source AS name, true AS is_nan, count(*) AS not_exists FROM {q._L} WHERE toxic IS NULL GROUP BY 1", _no_values)


def _quantile_near(s: SparkSession, d: str) -> DataFrame:
    """Whether the sketch's ranks are within its accuracy."""
    t = q.events(s, d)
    near = aggregate.buckets(t, t.select(), Agg("quantile", "value", "event_type", (0.5, 0.9), accuracy=1000)).select("name", "quantiles")
    rows = t.rows.join(near, t.rows["event_type"] == near["name"])
    return rows.groupBy("name").agg(*[(F.abs(F.avg((F.col("value") <= F.col("quantiles")[i]).cast("double")) - p) < 0.02).alias(f"near{i}") for i, p in enumerate((0.5, 0.9))])


_add("a_quantile_sketch", "SELECT event_type AS name, true AS near0, true AS near1 FROM events GROUP BY 1", _quantile_near)


def _raised(call: Callable[[], object]) -> str:
    try:
        call()
    except Exception as e:
        text = str(e)
        return "parse errors reached" if "parse errors reached" in text else text
    return "none"


def _errors(s: SparkSession, d: str) -> DataFrame:
    e, docs = _engine(s, d), Engine(s, q.documents(s, d))
    cases = {
        "no_field": lambda: e.aggregate("*", [Agg("sum")]), "no_group": lambda: e.aggregate("*", [Agg("unique")]), "count": lambda: e.aggregate("*", [Agg("count")]),
        "unique_ts": lambda: e.aggregate("*", [Agg("unique", group_by="user_id", interval_ms=1)]), "quantile": lambda: e.aggregate("*", [Agg("quantile", "value", quantiles=(1.5,))]), "function": lambda: e.aggregate("*", [Agg("mode", "value")]),
        "text": lambda: docs.aggregate("*", [Agg("count", group_by="text")]), "words": lambda: e.aggregate("*", [Agg("sum", "event_type")]), "groups": lambda: aggregate.answer(e.table, e.rows("*"), Agg("count", group_by="user_id"), most_groups=10),
        "groups_ts": lambda: aggregate.answer(e.table, e.rows("*"), Agg("count", group_by="user_id", interval_ms=DAY), most_groups=10), "values": lambda: aggregate.check_values(e.table, e.rows("*"), "user_id", 10), "nothing": lambda: e.complex_search("*"),
        "size": lambda: e.search("*", size=0), "offset": lambda: e.search("*", size=1, offset=-1), "hist": lambda: e.histogram("*", 0), "aggs": lambda: e.aggregate("*", []), "export": lambda: list(e.export("*", 100_001)), "job": lambda: e.jobs.state("unknown"),
    }
    return s.createDataFrame([(k, _raised(f)) for k, f in cases.items()], "case_ string, said string")


_SAID = {
    "no_field": "'field' must be set", "no_group": "'group_by' must be set", "count": "'field' or 'group_by' must be set", "unique_ts": "'interval' is not allowed for unique", "quantile": "'quantiles' must hold numbers from 0 to 1",
    "function": 'unknown aggregation function "mode"', "text": 'field "text": only keywords can be aggregated', "words": "parse errors reached", "groups": "too many unique values", "groups_ts": "too many unique values", "values": "too many unique values",
    "nothing": "one of 'size', 'hist' or 'aggs' must be set", "size": "'size' must be positive", "offset": "size and offset must not be negative", "hist": "'hist' must be set", "aggs": "'aggs' must be set", "export": "too many documents are requested, at most 100000", "job": "no search unknown",
}
_add("e_calls", "SELECT * FROM (VALUES " + ", ".join(f"({_text(k)}, {_text(v)})" for k, v in _SAID.items()) + ") AS t(case_, said)", _errors)
_PIPES = [
    ("* | fields", "parsing 'fields' pipe: empty list"), ("* | fields city,", "parsing 'fields' pipe: trailing comma not allowed"), ("* | sort city", "unknown pipe: sort"), ("* | fields a | fields b", "multiple field filters is not allowed"),
    ("city:in(oslo bergen)", "parsing 'in' filter: expect ')', got \"bergen\""), ("depth:[4 9]", "parsing range for field \"depth\": expected ',' keyword, got \"9\""), ("depth:[4, 9", "parsing range for field \"depth\": range end not found"), ("(city:oslo", "missing ')'"), ("* | fields except a, b", "none"),
]
_constant("e_queries", "query string, said string", lambda: [(x, _raised(lambda x=x: pipe.parse(x))) for x, _ in _PIPES], _PIPES)
_CANON = [
    ("pipe", "not (a:1 or not b:2)", "(not a:1 and b:2)"), ("pipe", "not a:1 and not b:2", "(not (a:1 or b:2))"), ("pipe", "not not a:1", "a:1"), ("pipe", "a:1 or b:2 and c:3", "(a:1 or (b:2 and c:3))"), ("pipe", 'a:"x y"', 'a:"x y"'),
    ("pipe", 'a:"say \\"hi\\""', 'a:"say \\"hi\\""'), ("pipe", "a:`x*y`", 'a:"x\\*y"'), ("pipe", 'a:"\\u00e9"', "a:é"), ("pipe", "a:in(1, z*)", "(a:1 or a:z*)"), ("pipe", "a:(1 to 5]", "a:(1, 5]"),
    ("legacy", "a:1 OR b:2 AND c:3", "(a:1 OR (b:2 AND c:3))"), ("legacy", "NOT (a:1 OR b:2)", "(NOT (a:1 OR b:2))"), ("legacy", 'a:"x y"', "a:x\\ y"), ("legacy", "a:[1 TO 5}", "a:[1 TO 5}"),
]
_constant("e_canonical", "dialect string, query string, canonical string", lambda: [(k, x, dump({"pipe": pipe, "legacy": legacy}[k].parse(x), legacy=k == "legacy")) for k, x, _ in _CANON], _CANON)
_DURATIONS = [("5ms", 5), ("10s", 10_000), ("2m", 120_000), ("3h", 10_800_000), ("1d", 86_400_000), ("1w", 604_800_000), ("1M", 2_592_000_000), ("1q", 7_862_400_000), ("1y", 31_536_000_000), ("-4s", -4000)]
_constant("x_duration", "spelt string, ms long", lambda: [(x, scalar.duration_ms(x)) for x, _ in _DURATIONS], _DURATIONS)


def _sent() -> list[tuple]:
    """What answers in JSON make of numbers that JSON lacks."""
    class Bucket:
        def __init__(self, value):
            self.name, self.value, self.not_exists, self.ts, self.quantiles = "x", value, 0, None, None

    sent = json.loads(Answer(aggs=[([Bucket(v) for v in (1.5, float("nan"), float("inf"), float("-inf"))], 0)]).to_json())
    return [(i, str(b["value"])) for i, b in enumerate(sent["aggs"][0]["buckets"])]


_constant("x_json_numbers", "place long, value string", _sent, [(0, "1.5"), (1, "NaN"), (2, "+Inf"), (3, "-Inf")])


def starred(s: SparkSession, d: str) -> LogTable:
    """Parts with marks in their names: an asterisk for the blank of each second one, nothing for each fifth."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).when(F.col("p_partkey") % 2 == 0, F.regexp_replace(F.lower("p_name"), " ", "*")).otherwise(F.lower("p_name"))
    rows = q._read(s, d, "part").withColumn("mark", name)
    return q._table(rows, F.col("p_partkey"), "p_partkey", {"mark": Column_("keyword", F.col("mark"))})


_MARK = "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN replace(lower(p_name), ' ', '*') ELSE lower(p_name) END"
_add("f_empty_value", f"SELECT p_partkey FROM part WHERE {_MARK} = ''", lambda s, d: starred(s, d).select('mark:""').select("p_partkey"))
_add("f_escaped_asterisk", f"SELECT p_partkey FROM part WHERE {_MARK} LIKE '%*%'", lambda s, d: starred(s, d).select(r'mark:*"\*"*').select("p_partkey"))


def resent(s: SparkSession, d: str) -> DataFrame:
    """Request bodies twice, a line each; both take what is dealt once, and as many tasks as there are parts."""
    sent = bodies(s, d).selectExpr("replace(replace(value, '\\\\', '\\\\\\\\'), '\n', '\\\\n') AS value")
    return sent.unionByName(sent)


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Request bodies as files, each sent twice, through the stream to the stored table, which has each document once, and what it leaves out."""
    source, path, bad = (scratch.folder(s, x) for x in ("bodies", "streamed", "left-out"))
    resent(s, d).write.text(source)
    lines = s.readStream.text(source).selectExpr("replace(value, '\\\\n', '\n') AS value")
    docs = bulk.requests(lines)
    mapping = from_dict(q._SPEC)
    ingest.start(docs, mapping, path, path + "-checkpoint", once=True, within="60 days", arrival=arrival(), drift_ms=40 * DAY).awaitTermination()
    ingest.start_rejected(docs, bad, bad + "-checkpoint", once=True).awaitTermination()
    t = store.read(s, path, mapping)
    kept = aggregate.buckets(t, t.select(), Agg("count", group_by="kind")).select("name", "value")
    return kept.unionByName(s.read.parquet(bad).groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")))


_add(
    "s_stream",
    f"WITH g AS (SELECT DISTINCT event_id // 100 AS g FROM events) SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events WHERE {_FINE} GROUP BY 1 UNION ALL SELECT 'unexpected action line', 2 * count(*) FROM g WHERE g % 20 = 7 UNION ALL SELECT r, 2 * count(*) FROM g, (VALUES ('not an object'), ('invalid JSON')) AS t(r) WHERE g % 20 <> 7 GROUP BY 1",
    _streamed,
)


def _counted(s: SparkSession, d: str) -> DataFrame:
    """Documents by tumbling windows, as the stream's last state has them."""
    source = scratch.folder(s, "lines")
    q._read(s, d, "events").select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"), F.col("event_id").alias("n"))).alias("value")).write.text(source)
    docs = s.readStream.text(source).select(F.col("value").alias("doc"))
    name = f"counted_{source[-12:]}"
    counts = ingest.counted(docs, "1 day", arrival=arrival(), drift_ms=40 * DAY).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    return s.table(name).select(scalar.mid_of(F.col("begin")).alias("begin"), "docs")


_add("s_stream_windows", f"SELECT {q._T} AS begin, count(*) AS docs FROM events GROUP BY 1", _counted)
