"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import scalar, text
from logweir.operators import aggregate, search, tools
from logweir.operators.aggregate import Agg
from logweir.operators.table import LogTable
from logweir.plans.ast import Fields as Chosen
from logweir.plans.compile import Column_, Fields
from logweir.sources import store
from logweir.sources.mapping import Field, Mapping, from_dict

DAY = 86_400_000
#: 2024-01-05 06:00 and 2024-01-20 18:30:00.250, in ms.
BEGIN, END = 1_704_434_400_000, 1_705_775_400_250
#: Texts are searched as a whole, whatever their size.
WHOLE = 2**31 - 1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(rows: DataFrame, mid: Column, rid: str, columns: dict[str, Column_], stamp: Column | None = None, doc: str = "doc") -> LogTable:
    return LogTable(rows, Fields(columns), mid, F.col(rid), Mapping({t: Field(t, c.kind) for t, c in columns.items()}), stamp, doc=doc)


def events(spark: SparkSession, sf_dir: str) -> LogTable:
    rows = _read(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k")
    columns = {"event_type": Column_("keyword", F.col("event_type")), "user_id": Column_("keyword", F.col("user_id"), "bigint"), "value": Column_("keyword", F.col("value"), "double"), "props.k": Column_("keyword", key)}
    return _table(rows, scalar.mid_of_ntz(F.col("ts")), "event_id", columns, F.col("ts"), "props")


def documents(spark: SparkSession, sf_dir: str) -> LogTable:
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    columns = {
        "text": Column_("text", text.words(F.col("text"), WHOLE), raw=F.col("text")), "lang": Column_("keyword", F.col("lang")), "source": Column_("keyword", F.col("source")),
        "quality": Column_("keyword", F.col("quality"), "int"), "toxic": Column_("keyword", F.col("toxic"), "int"), "n_chars": Column_("keyword", F.col("n_chars"), "bigint"),
    }
    return _table(rows, F.col("doc_id"), "doc_id", columns, doc="text")


def texts(spark: SparkSession, sf_dir: str) -> LogTable:
    own = documents(spark, sf_dir)
    own.rows = _read(spark, sf_dir, "documents")
    return own


def pages(spark: SparkSession, sf_dir: str) -> LogTable:
    rows = _read(spark, sf_dir, "pages")
    return _table(rows, F.col("page_id"), "page_id", {"url": Column_("path", text.prefixes(F.col("url"), WHOLE), whole=text.folded(F.col("url"), False))}, doc="html")


def parts(spark: SparkSession, sf_dir: str) -> LogTable:
    columns = {c: Column_("keyword", F.lower(c)) for c in ("p_type", "p_brand", "p_name")} | {"p_size": Column_("keyword", F.col("p_size"), "int")}
    return _table(_read(spark, sf_dir, "part"), F.col("p_partkey"), "p_partkey", columns)


def nested(spark: SparkSession, sf_dir: str) -> LogTable:
    """Orders with their lines as nested elements: a row for each order and for each line, which has its order's fields too."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lower("o_orderstatus").alias("status"), F.lower("o_orderpriority").alias("priority"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lower("l_returnflag").alias("rf"), F.col("l_linenumber").alias("ln"))
    rows = orders.withColumns({"rf": F.lit(None).cast("string"), "ln": F.lit(None).cast("int"), "nested_path": F.lit(None).cast("string")})
    rows = rows.unionByName(lines.join(orders, "key").withColumn("nested_path", F.lit("items")))
    columns = {"status": Column_("keyword", F.col("status")), "priority": Column_("keyword", F.col("priority")), "items.rf": Column_("keyword", F.col("rf")), "items.ln": Column_("keyword", F.col("ln"), "int")}
    return _table(rows, F.col("key"), "key", columns)


def _add(name: str, sql: str | None, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


MID = "epoch_us(ts) // 1000"
SPLIT = r"regexp_split_to_array(lower(text), '[^\pL\pN_*]+')"


def _filter(name: str, table, query: str, columns: list[str], source: str, where: str, dialect: str = "pipe", begin: int | None = None, end: int | None = None) -> None:
    _add(name, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}", lambda s, d: table(s, d).select(query, begin, end, dialect).select(*columns))


_E = ["event_id", "event_type", "user_id"]
_filter("f_all", events, "*", _E, "events", "true")
_filter("f_eq", events, "event_type:error", _E, "events", "event_type = 'error'")
_filter("f_eq_number", events, "user_id:8", _E, "events", "user_id = 8")
_filter("f_in", events, "event_type:in(error, purchase, sig*)", _E, "events", "event_type IN ('error', 'purchase') OR event_type LIKE 'sig%'")
_filter("f_not", events, "not event_type:error", _E, "events", "event_type IS DISTINCT FROM 'error'")
_filter("f_and_or_not", events, "(event_type:error or event_type:click) and not user_id:8 or value:[90, *]", _E, "events", "(event_type IN ('error', 'click') AND user_id IS DISTINCT FROM 8) OR value >= 90")
_filter("f_nand", events, "not user_id:in(1, 2, 3) and event_type:view", _E, "events", "event_type = 'view' AND user_id NOT IN (1, 2, 3)")
_filter("f_time_range", events, "*", _E, "events", f"{MID} BETWEEN {BEGIN} AND {END}", begin=BEGIN, end=END)
_filter("f_time_and_key", events, "event_type:view", _E, "events", f"{MID} BETWEEN {BEGIN} AND {END} AND event_type = 'view'", begin=BEGIN, end=END)
_filter("f_prefix", parts, "p_type:e*", ["p_partkey", "p_type"], "part", "lower(p_type) LIKE 'e%'")
_filter("f_suffix", parts, "p_brand:*7", ["p_partkey", "p_brand"], "part", "lower(p_brand) LIKE '%7'")
_filter("f_infix", parts, "p_name:r*d*g*", ["p_partkey", "p_name"], "part", "lower(p_name) LIKE 'r%d%g%'")
_filter("f_quoted", parts, "p_name:'small ring' or p_brand:\"brand#2\"*", ["p_partkey", "p_name"], "part", "lower(p_name) = 'small ring' OR lower(p_brand) LIKE 'brand#2%'")
_filter("f_num_range", events, "value:[10, 50)", _E, "events", "value >= 10 AND value < 50")
_filter("f_num_range_open", events, "value:(50.5 to *]", _E, "events", "value > 50.5")
_filter("f_num_range_token", events, "props.k:(10, 20]", _E, "events", "try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 10 AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) <= 20")
_filter("f_range_any_number", events, "event_type:[*, *] or props.k:[*, 5]", _E, "events", "try_cast(json_extract_string(props, '$.k') AS DOUBLE) <= 5")
_filter("f_text_range", texts, "lang:[de, es]", ["doc_id", "lang"], "documents", "lang >= 'de' AND lang <= 'es'")
_filter("f_text_all", texts, 'text:"THE of idiot"', ["doc_id"], "documents", f"list_contains({SPLIT}, 'the') AND list_contains({SPLIT}, 'of') AND list_contains({SPLIT}, 'idiot')")
_filter("f_text_wild", texts, "text:idi* and not text:scum", ["doc_id"], "documents", f"len(list_filter({SPLIT}, lambda x: x LIKE 'idi%')) > 0 AND NOT list_contains({SPLIT}, 'scum')")
_filter("f_path", pages, "url:'https://m.ththth.example.net/en'", ["page_id", "url"], "pages", "lower(url) = 'https://m.ththth.example.net/en' OR starts_with(lower(url), 'https://m.ththth.example.net/en/')")
_filter("f_path_prefix", pages, "url:'http:'", ["page_id", "url"], "pages", "starts_with(lower(url), 'http:/')")
_filter("f_path_wild", pages, "url:'*/en'", ["page_id", "url"], "pages", "lower(url) LIKE '%/en' OR lower(url) LIKE '%/en/%'")
_L = "documents LEFT JOIN labels USING (doc_id)"
_filter("f_exists", documents, "_exists_:toxic", ["doc_id"], _L, "toxic IS NOT NULL")
_filter("f_not_exists", documents, "not _exists_:toxic and lang:en", ["doc_id"], _L, "toxic IS NULL AND lang = 'en'")
_filter("f_not_missing", documents, "not toxic:1", ["doc_id"], _L, "toxic IS DISTINCT FROM 1")
_filter("f_legacy", events, 'event_type:"error" AND NOT user_id:[3 TO 9} OR value:{99 TO *]', _E, "events", "(event_type = 'error' AND NOT (user_id >= 3 AND user_id < 9)) OR value > 99", "legacy")
_filter("f_legacy_all", events, "_all_:* AND NOT event_type:cl*", _E, "events", "event_type NOT LIKE 'cl%'", "legacy")
_filter("f_comment", events, "# errors\nevent_type:error # of some\nand user_id:in(7, 8)", _E, "events", "event_type = 'error' AND user_id IN (7, 8)")
_filter("f_index", events, "_index:a or event_type:click", _E, "events", "event_type = 'click'")

_add("tok_text", f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter({SPLIT}, lambda x: len(x) > 0 AND octet_length(encode(x)) <= 72)) AS t FROM documents) GROUP BY t", lambda s, d: texts(s, d).rows.select(F.explode(text.words(F.col("text"), WHOLE)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
_add("tok_path", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(list_transform(list_filter(range(2, length(url) + 1), lambda i: substring(lower(url), i, 1) = '/'), lambda i: substring(lower(url), 1, i - 1)), [lower(url)]))) AS t FROM pages) GROUP BY t", lambda s, d: pages(s, d).rows.select(F.explode(text.prefixes(F.col("url"), WHOLE)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
_add("tok_keyword", "SELECT page_id, CASE WHEN octet_length(encode(url)) <= 40 THEN lower(url) END AS token FROM pages", lambda s, d: pages(s, d).rows.select("page_id", text.keyword(F.col("url"), 40).alias("token")))
_add("tok_keyword_partial", "SELECT page_id, lower(substring(url, 1, 40)) AS token FROM pages", lambda s, d: pages(s, d).rows.select("page_id", text.keyword(F.col("url"), 40, partial=True).alias("token")))


def _page(name: str, query: str, where: str, size: int, offset: int, ascending: bool) -> None:
    way = "" if ascending else " DESC"
    sql = f"SELECT event_id, {MID} AS mid FROM events WHERE {where} ORDER BY mid{way}, event_id{way} LIMIT {size} OFFSET {offset}"

    def make(s: SparkSession, d: str) -> DataFrame:
        t = events(s, d)
        return search.page(t, t.select(query), size, offset, ascending).select("event_id", t.mid.alias("mid"))

    _add(name, sql, make)


_page("o_desc", "event_type:error and not user_id:8", "event_type = 'error' AND user_id <> 8", 10, 0, False)
_page("o_asc", "*", "true", 100, 0, True)
_page("o_page", "value:[20, *]", "value >= 20", 100, 4900, False)
_add("o_total", "SELECT count(*) AS total FROM events WHERE event_type = 'error'", lambda s, d: events(s, d).select("event_type:error").agg(F.count(F.lit(1)).alias("total")))


def _projected(fields: Chosen) -> Callable[[SparkSession, str], DataFrame]:
    def make(s: SparkSession, d: str) -> DataFrame:
        doc = F.to_json(F.struct("event_id", "event_type", F.struct("user_id").alias("who"), F.col("props")))
        rows = _read(s, d, "events").select("event_id", search.selected(doc, fields).alias("doc"))
        return rows.select("event_id", F.get_json_object("doc", "$.event_type").alias("kind"), F.get_json_object("doc", "$.who.user_id").cast("long").alias("who"), F.get_json_object("doc", "$.event_id").cast("long").alias("own_id"), F.get_json_object("doc", "$.props").alias("own_props"))

    return make


_add("p_fields", "SELECT event_id, event_type AS kind, user_id AS who, CAST(NULL AS BIGINT) AS own_id, CAST(NULL AS VARCHAR) AS own_props FROM events", _projected(Chosen(("event_type", "who", "unknown"))))
_add("p_except", "SELECT event_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS who, event_id AS own_id, props AS own_props FROM events", _projected(Chosen(("event_type", "who"), True)))


def _agg(name: str, table, agg: Agg, sql: str, query: str = "*") -> None:
    def make(s: SparkSession, d: str) -> DataFrame:
        t = table(s, d)
        out = aggregate.buckets(t, t.select(query), agg)
        kept = ["name", F.round("value", 4).alias("value"), "not_exists"] + ["ts"] * bool(agg.interval_ms)
        for i in range(len(agg.quantiles)):
            kept.append(F.round(F.get("quantiles", F.lit(i)), 4).alias(f"q{i}"))
        rows = out.select(*kept)
        return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))

    _add(name, sql, make)


_T = f"{MID} - {MID} % {DAY}"
_agg("a_count", events, Agg("count", group_by="event_type"), "SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1")
_agg("a_count_missing", documents, Agg("count", group_by="toxic"), f"SELECT coalesce(CAST(toxic AS VARCHAR), '_not_exists') AS name, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM {_L} GROUP BY 1")
_agg("a_count_field_wins", documents, Agg("count", field="source", group_by="lang"), "SELECT source AS name, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM documents GROUP BY 1")
for _f in ("sum", "min", "max", "avg"):
    _agg(f"a_{_f}", events, Agg(_f, "value"), f"SELECT '' AS name, round({_f}(value), 4) AS value, CAST(0 AS BIGINT) AS not_exists FROM events WHERE event_type <> 'click'", "not event_type:click")
    _agg(f"a_{_f}_by", events, Agg(_f, "value", "event_type"), f"SELECT event_type AS name, round({_f}(value), 4) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1")
    _agg(f"a_{_f}_missing", documents, Agg(_f, "toxic", "source"), f"SELECT source AS name, round(CAST({_f}(toxic) AS DOUBLE), 4) AS value, count(*) FILTER (toxic IS NULL) AS not_exists FROM {_L} GROUP BY 1")
    _agg(f"a_ts_{_f}", events, Agg(_f, "value", "event_type", interval_ms=DAY), f"SELECT {_T} AS ts, event_type AS name, round({_f}(value), 4) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1, 2")
_agg("a_ts_count", events, Agg("count", group_by="event_type", interval_ms=DAY), f"SELECT {_T} AS ts, event_type AS name, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1, 2")
_agg("a_ts_plain", events, Agg("max", "value", interval_ms=DAY), f"SELECT {_T} AS ts, '' AS name, round(max(value), 4) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1")
_agg("a_token_sum", events, Agg("sum", "props.k", "event_type"), "SELECT event_type AS name, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM events GROUP BY 1")
_agg("a_unique", events, Agg("unique", group_by="user_id"), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS name, CAST(0 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS not_exists FROM events")
_RANK = "list_sort(list(value))[CAST(floor((count(value) - 1) * {q} + 0.5) AS BIGINT) + 1]"
_Q = ", ".join(f"round({_RANK.format(q=q)}, 4) AS q{i}" for i, q in enumerate((0.5, 0.0, 0.95, 1.0)))
_qs = (0.5, 0.0, 0.95, 1.0)
_agg("a_quantile", events, Agg("quantile", "value", quantiles=_qs), f"SELECT '' AS name, round({_RANK.format(q=0.5)}, 4) AS value, CAST(0 AS BIGINT) AS not_exists, {_Q} FROM events")
_agg("a_quantile_by", events, Agg("quantile", "value", "event_type", _qs), f"SELECT event_type AS name, round({_RANK.format(q=0.5)}, 4) AS value, CAST(0 AS BIGINT) AS not_exists, {_Q} FROM events GROUP BY 1")
_agg("a_ts_quantile", events, Agg("quantile", "value", "event_type", _qs, DAY), f"SELECT {_T} AS ts, event_type AS name, round({_RANK.format(q=0.5)}, 4) AS value, CAST(0 AS BIGINT) AS not_exists, {_Q} FROM events GROUP BY 1, 2")


def _lost(s: SparkSession, d: str) -> DataFrame:
    t = documents(s, d)
    return aggregate.not_exists(t, t.select("lang:en"), Agg("sum", "n_chars", "toxic"))


_add("a_not_exists", f"SELECT count(*) FILTER (toxic IS NULL AND n_chars IS NOT NULL) AS not_exists FROM {_L} WHERE lang = 'en'", _lost)


def _hist(s: SparkSession, d: str) -> DataFrame:
    t = events(s, d)
    return search.histogram(t, t.select("event_type:error"), 3_600_000)


_add("h_hist", f"SELECT {MID} - {MID} % 3600000 AS bucket, count(*) AS docs FROM events WHERE event_type = 'error' GROUP BY 1", _hist)


def _fetch(s: SparkSession, d: str) -> DataFrame:
    t = events(s, d)
    ids = search.page(t, t.select("event_type:error"), 50).select(t.mid.alias("want_mid"), F.col("event_id").alias("want_rid"))
    ids = ids.union(s.createDataFrame([(1_704_067_207_179, -5)], "want_mid long, want_rid long")).withColumn("pos", (F.lit(1000) - F.col("want_rid") % 1000).cast("int") * 100000 + (F.col("want_rid") / 1000).cast("int"))
    return search.fetch(t, ids.select("pos", "want_mid", "want_rid")).select("id", F.get_json_object("doc", "$.k").alias("k"))


_HEX = "lower(array_to_string(list_transform(range(0, 8), lambda i: lpad(hex(({x} >> (8 * i)) & 255), 2, '0')), ''))"
_ID = f"{_HEX.format(x=f'({MID})')} || '-' || {_HEX.format(x='event_id')}"
_add("l_fetch", f"SELECT id, k FROM (SELECT {_ID} AS id, json_extract_string(props, '$.k') AS k, {MID} AS mid, event_id FROM events WHERE event_type = 'error' ORDER BY mid DESC, event_id DESC LIMIT 50) UNION ALL SELECT '0b1052c28c010000-fbffffffffffffff', NULL", _fetch)
_add("x_id_hex", f"SELECT event_id, {_ID} AS id FROM events", lambda s, d: events(s, d).rows.select("event_id", scalar.id_text(scalar.mid_of_ntz(F.col("ts")), F.col("event_id")).alias("id")))
_add("d_dedup", f"SELECT DISTINCT {MID} AS mid, event_id FROM events", lambda s, d: (t := events(s, d)).rows.unionByName(t.rows).select(t.mid.alias("mid"), "event_id").dropDuplicates(["mid", "event_id"]))


def _nested_ids(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: nested(s, d).select(query).select("key").distinct()


_add("n_nested", "SELECT DISTINCT l_orderkey AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 1", _nested_ids("items.rf:r and items.ln:1"))
_add("n_nested_not", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = 2", _nested_ids("not items.rf:r and items.ln:2"))
_add("n_nested_parent", "SELECT DISTINCT o_orderkey AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber >= 6", _nested_ids("status:f and items.ln:[6, *]"))
_add("n_nested_total", "SELECT lower(o_orderpriority) AS name, CAST(sum(1 + n) AS DOUBLE) AS value FROM (SELECT o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey, o_orderpriority) GROUP BY 1", lambda s, d: aggregate.buckets(t := nested(s, d), t.select("status:f"), Agg("count", group_by="priority")).select("name", "value"))


_SPEC = {"mapping-list": [
    {"name": "kind", "type": "keyword"}, {"name": "value", "type": "keyword"}, {"name": "user", "type": "object", "mapping-list": [{"name": "id", "type": "keyword"}]},
    {"name": "tags", "type": "tags"}, {"name": "tags.k", "type": "keyword"}, {"name": "note", "types": [{"type": "text"}, {"title": "keyword", "type": "keyword", "size": 23}]},
    {"name": "seen", "type": "exists"}, {"name": "spans", "type": "nested", "mapping-list": [{"name": "id", "type": "keyword"}]},
]}


def sent_events(s: SparkSession, d: str) -> DataFrame:
    """Events as stamped JSON documents."""
    tags = F.array(F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("other").alias("key"), F.lit("x").alias("value")))
    spans = F.array(F.struct(F.col("user_id").alias("id")), F.struct((F.col("user_id") + 1).alias("id")))
    note = F.concat(F.lit("Event of "), F.col("event_type"), F.lit(": user-"), F.col("user_id"))
    doc = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), F.col("event_id").alias("n"), F.upper("event_type").alias("kind"), "value", F.struct(F.col("user_id").alias("id")).alias("user"), tags.alias("tags"), note.alias("note"), F.when(F.col("user_id") > 100, F.lit(1)).alias("seen"), spans.alias("spans")))
    docs = _read(s, d, "events").select(doc.alias("doc"))
    arrival = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    return store.stamped(docs, arrival, drift_ms=40 * DAY)


def ingested(s: SparkSession, d: str) -> LogTable:
    """Events, through the whole way of ingest."""
    mapping = from_dict(_SPEC)
    return store.table(store.index_rows(sent_events(s, d), mapping), mapping)


def _ingest(name: str, query: str, where: str) -> None:
    own = lambda: F.get_json_object("doc", "$.n").cast("long").alias("n")
    _add(name, f"SELECT event_id AS n, {MID} AS mid FROM events WHERE {where}", lambda s, d: ingested(s, d).select(query).select(own(), "mid").distinct())


_ingest("i_all", "*", "true")
_ingest("i_keyword", "kind:error and user.id:8", "event_type = 'error' AND user_id = 8")
_ingest("i_tags", "tags.k:69", "json_extract_string(props, '$.k') = '69'")
_ingest("i_text", 'note:"user view"', "event_type = 'view'")
_ingest("i_multi_type", 'note.keyword:"event of view: us"*', "event_type = 'view' AND length('Event of view: user-' || user_id) <= 23")
_ingest("i_exists", "_exists_:seen and not _exists_:nothing", "user_id > 100")
_ingest("i_nested", "spans.id:8 and kind:click", "event_type = 'click' AND user_id IN (7, 8)")
_ingest("i_range", "value:[10, 20)", "value >= 10 AND value < 20")
_add("i_rows", "SELECT nested_path, count(*) AS n FROM (SELECT NULL AS nested_path FROM events UNION ALL SELECT 'spans' FROM events UNION ALL SELECT 'spans' FROM events) GROUP BY 1", lambda s, d: ingested(s, d).rows.groupBy("nested_path").agg(F.count(F.lit(1)).alias("n")))
_add("t_tags", "SELECT json_extract_string(props, '$.k') AS name, CAST(count(*) * 3 AS DOUBLE) AS value FROM events GROUP BY 1", lambda s, d: aggregate.buckets(t := ingested(s, d), t.select(), Agg("count", group_by="tags.k")).select("name", "value"))
_add("t_object", "SELECT CAST(user_id AS VARCHAR) AS name, CAST(count(*) * 3 AS DOUBLE) AS value FROM events GROUP BY 1", lambda s, d: aggregate.buckets(t := ingested(s, d), t.select(), Agg("count", group_by="user.id")).select("name", "value"))


def _tiers(s: SparkSession, d: str) -> DataFrame:
    hot, cold = events(s, d), events(s, d)
    cold.rows = cold.rows.withColumn("event_type", F.upper("event_type"))
    return hot.union(cold, BEGIN).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


_add("u_hot_cold", f"SELECT CASE WHEN {MID} >= {BEGIN} THEN event_type ELSE upper(event_type) END AS event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1", _tiers)
_add("x_floor", f"SELECT event_id, {MID} AS mid, {_T} AS day FROM events", lambda s, d: (t := events(s, d)).rows.select("event_id", t.mid.alias("mid"), scalar.floor_to(t.mid, DAY).alias("day")))


def _times(s: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    texts_ = [F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'+03:00'"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd")]
    return _read(s, d, "events").select("event_id", *[scalar.mid_of(scalar.parsed_time(x)).alias(f"t{i}") for i, x in enumerate(texts_)])


_add("x_time_parse", f"SELECT event_id, {MID} AS t0, {MID} - 10800000 AS t1, ({MID}) // 1000 * 1000 AS t2, CAST(NULL AS BIGINT) AS t3 FROM events", _times)
_add("x_clamp", f"SELECT event_id, CASE WHEN {MID} < {END} - {DAY} OR {MID} > {END} + 300000 THEN {END} ELSE {MID} END AS mid FROM events", lambda s, d: (t := events(s, d)).rows.select("event_id", scalar.clamped(t.mid, F.lit(END).cast("long")).alias("mid")))
_add("x_number", "SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand, '[0-9]+'), '') AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS none FROM part", lambda s, d: _read(s, d, "part").select("p_partkey", scalar.number(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("n"), scalar.number(F.concat(F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("d"))).alias("none")))
_add("t1_tokens", "SELECT lang AS token, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY 1", lambda s, d: tools.tokens(texts(s, d), "lang"))
_add("t1_cardinality", f"SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS postings, max(n) AS largest FROM (SELECT t, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_filter({SPLIT}, lambda x: len(x) > 0 AND octet_length(encode(x)) <= 72))) AS t FROM documents) GROUP BY t)", lambda s, d: tools.cardinality(texts(s, d), "text"))
_add("t2_minutes", f"SELECT {MID} - {MID} % 60000 AS minute, count(*) AS docs FROM events GROUP BY 1", lambda s, d: tools.minutes(events(s, d)))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Errors of most users in a range of time: buckets by day, with the share of each user."""
    t = events(s, d)
    rows = t.select("event_type:in(error, click) and not user_id:8 and value:[5, *]", BEGIN, END)
    return aggregate.buckets(t, rows, Agg("avg", "value", "event_type", interval_ms=DAY)).select("ts", "name", F.round("value", 4).alias("value"))


_add("flagship", f"SELECT {_T} AS ts, event_type AS name, round(avg(value), 4) AS value FROM events WHERE event_type IN ('error', 'click') AND user_id IS DISTINCT FROM 8 AND value >= 5 AND {MID} BETWEEN {BEGIN} AND {END} GROUP BY 1, 2", flagship)
