"""The queries of this library by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import scalars as fn
from tarnlight.functions.tokens import has_all_tokens, tokens
from tarnlight.operators import catalog, histograms, maintenance, metrics, search, selectors, traces
from tarnlight.plans import store
from tarnlight.sources import journal, native, otlp
from tarnlight.sources.paths import new_path
from tarnlight.sources import tables as t
from tarnlight.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY_MS, DAY_NS = 86_400_000, 86_400_000_000_000
#: Days 10 and 20 of the events' month.
T10, T20 = 1_704_844_800_000, 1_705_708_800_000
GAUGE, COUNTER = selectors.Selector.parse("event_value"), selectors.Selector.parse("event_total")
STEPS = metrics.Steps(T10, T20, 6 * 3_600_000, 24 * 3_600_000)
LOG_COLUMNS = ["id", "ts_ns", "level", "service", "host", "trace_id", "body"]

_US = "epoch_us(ts)"
_LOGS = f"""logs AS (
  SELECT lpad(lower(to_hex(event_id)), 32, '0') AS id, {_US} * 1000 AS ts_ns,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS level,
    'svc-' || user_id % 6 AS service, 'host-' || user_id % 10 AS host, lpad(lower(to_hex(user_id + 1)), 32, '0') AS trace_id,
    CASE WHEN event_id % 2 = 0 THEN lpad(lower(to_hex(event_id % 7 + 1)), 16, '0') END AS span_id, event_type || ' user ' || user_id AS body,
    regexp_extract(props, '"k": *([0-9]+)', 1) AS k, event_type FROM events)"""
_SPANS = """spans AS (
  SELECT lpad(lower(to_hex(l_orderkey)), 10, '0') || lpad(lower(to_hex(l_linenumber)), 2, '0') || lpad(lower(to_hex(l_partkey)), 10, '0') || lpad(lower(to_hex(l_suppkey)), 10, '0') AS id, lpad(lower(to_hex(l_orderkey)), 32, '0') AS trace_id,
    lpad(lower(to_hex(l_linenumber)), 16, '0') AS span_id, CASE WHEN l_linenumber > 1 THEN lpad('1', 16, '0') END AS parent_id, 'svc-' || l_suppkey % 5 AS service,
    l_returnflag || l_linestatus AS operation, epoch_us(l_shipdate) * 1000 + l_linenumber * 1000000 AS start_ns,
    epoch_us(l_shipdate) * 1000 + l_linenumber * 1000000 + (l_quantity * 1000000)::BIGINT AS end_ns,
    CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'OK' ELSE 'UNSET' END AS status, l_partkey::VARCHAR AS partkey, l_orderkey * 8 + l_linenumber AS ingest_seq FROM lineitem)"""
_UNIQUE = "own AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingest_seq DESC, id DESC) = 1)"
_SCALED = "round(value * 1000)::BIGINT"
_KEY = """'"__name__"="' || name || '","event_type"="' || event_type || '","user_bucket"="' || user_id % 8 || '"' AS series_key"""
_GAUGES = f"gauges AS (SELECT {_KEY.replace('name ||', chr(39) + 'event_value' + chr(39) + ' ||')}, event_type, (user_id % 8)::VARCHAR AS user_bucket, {_US} // 1000 AS ts_ms, {_SCALED} AS value, event_id AS ingest_seq FROM events)"
_COUNTERS = f"counters AS (SELECT {_KEY.replace('name ||', chr(39) + 'event_total' + chr(39) + ' ||')}, event_type, (user_id % 8)::VARCHAR AS user_bucket, {_US} // 1000 AS ts_ms, (event_id * 7919 + {_SCALED}) % 1000000 AS value, event_id AS ingest_seq FROM events)"
_GRID = f"grid AS (SELECT {STEPS.start_ms} + i * {STEPS.step_ms} AS step_ms FROM range({STEPS.last + 1}) r(i))"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Binary ids as hexadecimal text."""
    return df.select(*[F.lower(F.hex("id")).alias("id") if c == "id" else F.col(c) for c in columns])


def _log_query(name: str, query: search.LogQuery, where: str, limit: int = search.DEFAULT_LIMIT) -> None:
    sql = f"WITH {_LOGS} SELECT {', '.join(LOG_COLUMNS)} FROM logs WHERE {where} ORDER BY ts_ns DESC, id DESC LIMIT {limit}"
    register(name, sql)(lambda spark, d: _shown(search.search_logs(t.logs(spark, d), query), LOG_COLUMNS))


register("log_scan", f"WITH {_LOGS} SELECT {', '.join(LOG_COLUMNS)} FROM logs")(lambda spark, d: _shown(t.logs(spark, d), LOG_COLUMNS))
_log_query("log_page", search.LogQuery(levels=["ERROR"], start_ns=T10 * 1_000_000, end_ns=T20 * 1_000_000), f"level = 'ERROR' AND ts_ns BETWEEN {T10 * 1_000_000} AND {T20 * 1_000_000}")
_log_query("log_newest", search.LogQuery(), "true")
_log_query("log_level_service", search.LogQuery(levels=["WARN", "ERROR"], services=["svc-0", "svc-2"], limit=50), "level IN ('WARN', 'ERROR') AND service IN ('svc-0', 'svc-2')", 50)
_log_query("log_small_letter_level", search.LogQuery(levels=["error"]), "false")
_log_query("log_host", search.LogQuery(hosts=["host-1", "host-7"], limit=1000), "host IN ('host-1', 'host-7')", 1000)
_log_query("log_time_range", search.LogQuery(start_ns=T10 * 1_000_000, end_ns=(T10 + DAY_MS) * 1_000_000, limit=100_000), f"ts_ns BETWEEN {T10 * 1_000_000} AND {(T10 + DAY_MS) * 1_000_000}", 100_000)
_log_query("log_attr", search.LogQuery(attrs={"event_type": "click", "k": "7"}, limit=1000), "event_type = 'click' AND k = '7'", 1000)
_log_query("log_trace", search.LogQuery(trace_id=f"{8:032x}", limit=1000), f"trace_id = '{8:032x}'", 1000)
_log_query("log_text", search.LogQuery(text="Purchase user", limit=200), "level = 'INFO'", 200)
_log_query("log_exact_text", search.LogQuery(exact_text="Purchase user", services=["svc-2"], limit=200), "level = 'INFO' AND service = 'svc-2'", 200)
_log_query("log_text_no_token", search.LogQuery(text="--"), "false")
_CURSOR = search.Cursor(T20 * 1_000_000, bytes(16))
_log_query("log_page2", search.LogQuery(cursor=_CURSOR.encode(), services=["svc-1"]), f"service = 'svc-1' AND ts_ns < {_CURSOR.ts_ns}")


@register("log_level_counts", f"WITH {_LOGS} SELECT service, level, count(*) AS records, sum(octet_length(encode(body)))::BIGINT AS body_bytes, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM logs GROUP BY ALL")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.log_stats(t.logs(spark, d))


@register(
    "log_ndjson",
    f"""WITH {_LOGS}, parts AS (
  SELECT *, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S') AS s, rtrim(lpad((ts_ns % 1000000000)::VARCHAR, 9, '0'), '0') AS f FROM logs)
SELECT '{{"_msg":"' || body || '","_time":"' || s || CASE WHEN ts_ns % 1000000000 = 0 THEN '' ELSE '.' || f END || 'Z","event_type":"' || event_type || '","host":"' || host || '","k":"' || k || '","level":"' || level || '","service":"' || service || '"'
  || CASE WHEN span_id IS NULL THEN '' ELSE ',"span_id":"' || span_id || '"' END || ',"trace_id":"' || trace_id || '"}}' AS line FROM parts""",
)
def ndjson(spark: SparkSession, d: str) -> DataFrame:
    return search.ndjson(t.logs(spark, d))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@register("text_all_tokens", f"SELECT doc_id, source FROM documents WHERE list_has_all({_TOKENS}, ['the', 'of', 'anea'])")
def text_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    return t.document_logs(spark, d).filter(has_all_tokens(F.col("body"), "the of ANEA")).select(F.col("ingest_seq").alias("doc_id"), F.col("service").alias("source"))


@register("text_token_counts", f"SELECT source, sum(len({_TOKENS}))::BIGINT AS tokens, count(*) AS records FROM documents GROUP BY source")
def text_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return t.document_logs(spark, d).groupBy(F.col("service").alias("source")).agg(F.sum(F.size(tokens(F.col("body"))).cast("bigint")).alias("tokens"), F.count("*").alias("records"))


@register("text_stemmed", f"WITH {_LOGS} SELECT id, body FROM logs WHERE event_type = 'purchase'")
def text_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Stored logs are found by another form of a word of their body."""
    path = new_path(spark, "segments")
    maintenance.write_segments(t.logs(spark, d), path)
    return _shown(search.matching(spark.read.parquet(path), search.LogQuery(text="purchasing Users")), ["id", "body"])


register("text_stemmed_scan", f"WITH {_LOGS} SELECT id, body FROM logs WHERE event_type = 'click'")(lambda spark, d: _shown(search.matching(t.logs(spark, d), search.LogQuery(text="clicked")), ["id", "body"]))
SPAN_COLUMNS = ["id", "trace_id", "span_id", "parent_id", "service", "operation", "start_ns", "end_ns", "status"]


def _span_query(name: str, query: search.SpanQuery, where: str, limit: int = search.DEFAULT_LIMIT) -> None:
    sql = f"WITH {_SPANS} SELECT {', '.join(SPAN_COLUMNS)} FROM spans WHERE {where} ORDER BY start_ns DESC, id DESC LIMIT {limit}"
    register(name, sql)(lambda spark, d: _shown(search.search_spans(t.spans(spark, d), query), SPAN_COLUMNS))


_span_query("span_newest", search.SpanQuery(), "true")
_span_query("span_duration_status", search.SpanQuery(statuses=["ERROR", "OK"], min_duration_ns=7_000_000, max_duration_ns=30_000_000, limit=500), "status IN ('ERROR', 'OK') AND end_ns - start_ns BETWEEN 7000000 AND 30000000", 500)
_span_query("span_operation_service", search.SpanQuery(operations=["NO", "AF"], services=["svc-3"], limit=300), "operation IN ('NO', 'AF') AND service = 'svc-3'", 300)
_span_query("span_trace", search.SpanQuery(trace_id=f"{5:032x}"), f"trace_id = '{5:032x}'")
_span_query("span_attr", search.SpanQuery(attrs={"partkey": "17"}, limit=1000), "partkey = '17'", 1000)
_span_query("span_page2", search.SpanQuery(cursor=search.Cursor(1_000_000_000 * 1_000_000_000, bytes(16)).encode(), limit=40), "start_ns < 1000000000000000000", 40)


def _summaries_sql(where: str = "true", tail: str = "") -> str:
    return f"""WITH {_SPANS}
SELECT trace_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, (max(end_ns) - min(start_ns)) // 1000000 AS duration_ms, count(*) AS span_count, bool_or(status = 'ERROR') AS has_error,
  coalesce(arg_min(service, (start_ns, id)) FILTER (parent_id IS NULL), arg_max(service, (start_ns, id))) AS root_service,
  coalesce(arg_min(operation, (start_ns, id)) FILTER (parent_id IS NULL), arg_max(operation, (start_ns, id))) AS root_operation
FROM spans WHERE {where} GROUP BY trace_id {tail}"""


register("trace_summaries", _summaries_sql())(lambda spark, d: traces.trace_summaries(t.spans(spark, d)))
register("trace_summaries_matching", _summaries_sql("service = 'svc-2' AND end_ns - start_ns >= 3000000"))(lambda spark, d: traces.trace_summaries(t.spans(spark, d), search.SpanQuery(services=["svc-2"], min_duration_ns=3_000_000)))
register("trace_page", _summaries_sql("status = 'ERROR'", "ORDER BY start_ns DESC, trace_id LIMIT 20 OFFSET 10"))(lambda spark, d: traces.trace_summaries(t.spans(spark, d), search.SpanQuery(statuses=["ERROR"]), 20, 10))

_EDGES = f"""{_UNIQUE}, edges AS (
  SELECT c.trace_id, c.span_id, c.parent_id, c.service, c.operation, c.start_ns, c.end_ns, c.status, p.service AS parent_service, p.operation AS parent_operation, p.span_id IS NULL AS is_root,
    c.start_ns - min(c.start_ns) OVER (PARTITION BY c.trace_id) AS offset_ns
  FROM own c LEFT JOIN own p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id)"""
register("trace_edges", f"WITH {_SPANS}, {_EDGES} SELECT * FROM edges")(lambda spark, d: traces.trace_edges(t.spans(spark, d)))


@register(
    "trace_tree",
    f"""WITH RECURSIVE {_SPANS}, {_EDGES}, tree AS (
  SELECT *, 0 AS depth, span_id AS path FROM edges WHERE is_root
  UNION ALL SELECT e.*, tree.depth + 1, tree.path || '/' || e.span_id FROM edges e JOIN tree ON e.trace_id = tree.trace_id AND e.parent_id = tree.span_id)
SELECT * FROM tree""",
)
def trace_tree(spark: SparkSession, d: str) -> DataFrame:
    return traces.trace_tree(t.spans(spark, d))


CHAIN = 80


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Events as traces of chains, each span the parent of the next; of every third trace the first one hangs under the last, a cycle."""
    n, chain = F.col("event_id") % CHAIN, F.expr(f"event_id div {CHAIN}")
    parent = F.when(n > 0, t.padded_hex(n, 16)).when(chain % 3 == 0, t.padded_hex(F.lit(CHAIN), 16))
    return t.read(spark, d, "events").select(
        F.unhex(t.padded_hex(F.col("event_id"), 32)).alias("id"), t.padded_hex(chain + 1, 32).alias("trace_id"), t.padded_hex(n + 1, 16).alias("span_id"), parent.alias("parent_id"), F.col("event_type").alias("service"), F.col("event_type").alias("operation"),
        (F.col("event_id") * 1000).alias("start_ns"), (F.col("event_id") * 1000 + 5).alias("end_ns"), F.lit("OK").alias("status"), F.col("event_id").alias("ingest_seq"),
    )


@register(
    "trace_tree_chains",
    f"""WITH RECURSIVE c AS (SELECT event_id // {CHAIN} AS chain, event_id % {CHAIN} AS n, event_id FROM events),
tree AS (
  SELECT chain, n, 0 AS depth, lpad(lower(to_hex(n + 1)), 16, '0') AS path FROM c WHERE (n = 0 AND (chain % 3 <> 0 OR NOT EXISTS (FROM c x WHERE x.chain = c.chain AND x.n = {CHAIN} - 1)))
    OR (n > 0 AND NOT EXISTS (FROM c x WHERE x.chain = c.chain AND x.n = c.n - 1))
  UNION ALL SELECT c.chain, c.n, depth + 1, path || '/' || lpad(lower(to_hex(c.n + 1)), 16, '0') FROM tree JOIN c ON c.chain = tree.chain AND c.n = tree.n + 1 WHERE tree.depth < {CHAIN})
SELECT lpad(lower(to_hex(chain + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(n + 1)), 16, '0') AS span_id, depth, path FROM tree""",
)
def trace_tree_chains(spark: SparkSession, d: str) -> DataFrame:
    return traces.trace_tree(_chains(spark, d)).select("trace_id", "span_id", "depth", "path")


register("trace_total", f"WITH {_SPANS} SELECT count(DISTINCT trace_id) AS total FROM spans WHERE status = 'ERROR'")(lambda spark, d: traces.trace_total(t.spans(spark, d), search.SpanQuery(statuses=["ERROR"])))


@register(
    "trace_log_join",
    f"""WITH {_SPANS}, {_LOGS}, {_UNIQUE}, mine AS (SELECT trace_id, span_id, count(*) AS n, min(ts_ns) AS first_ts FROM logs WHERE span_id IS NOT NULL GROUP BY ALL)
SELECT o.trace_id, o.span_id, coalesce(n, 0)::INTEGER AS log_count, first_ts FROM own o LEFT JOIN mine m ON o.trace_id = m.trace_id AND o.span_id = m.span_id""",
)
def trace_log_join(spark: SparkSession, d: str) -> DataFrame:
    return traces.logs_of_spans(t.spans(spark, d), t.logs(spark, d)).select("trace_id", "span_id", "log_count", F.try_element_at("logs", F.lit(1))["ts_ns"].alias("first_ts"))


@register("trace_lookup", f"WITH {_SPANS}, {_LOGS} SELECT 'span' AS kind, id, start_ns AS ts_ns, operation AS what FROM spans WHERE trace_id = '{7:032x}' UNION ALL SELECT 'log', id, ts_ns, body FROM logs WHERE trace_id = '{7:032x}'")
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    s, logs = traces.lookup_trace(t.spans(spark, d), t.logs(spark, d), f"{7:032x}")
    hexed = F.lower(F.hex("id")).alias("id")
    return s.select(F.lit("span").alias("kind"), hexed, F.col("start_ns").alias("ts_ns"), F.col("operation").alias("what")).union(logs.select(F.lit("log"), hexed, "ts_ns", "body"))


register("services", f"WITH {_LOGS}, {_SPANS} SELECT service FROM logs UNION SELECT service FROM spans")(lambda spark, d: catalog.services(t.logs(spark, d), t.spans(spark, d)))


def _renamed(rows: DataFrame, prefix: str) -> DataFrame:
    """Samples or histograms whose metric's name holds their event type."""
    return rows.select(F.create_map(F.lit("__name__"), F.concat(F.lit(prefix), F.col("labels")["event_type"])).alias("labels"))


register("metric_names", "SELECT DISTINCT 'value_' || event_type AS name FROM events UNION SELECT DISTINCT 'total_' || event_type FROM events WHERE user_id % 8 = 3")(
    lambda spark, d: catalog.metric_names(_renamed(t.gauges(spark, d), "value_").union(_renamed(t.counters(spark, d).filter(F.col("labels")["user_bucket"] == "3"), "total_")))
)
register("label_values", "SELECT DISTINCT event_type AS value FROM events")(lambda spark, d: catalog.label_values(t.gauges(spark, d), "event_type"))
register("histogram_names", "SELECT DISTINCT 'duration_' || event_type AS name FROM events UNION SELECT DISTINCT 'size_' || event_type FROM events")(
    lambda spark, d: catalog.metric_names(_renamed(t.exp_histograms(spark, d), "duration_").union(_renamed(t.explicit_histograms(spark, d), "size_")))
)
register("store_stats", f"WITH {_GAUGES} SELECT 'event_value' AS name, count(DISTINCT series_key) AS series, count(*)::BIGINT AS samples, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM gauges")(lambda spark, d: catalog.metric_stats(t.gauges(spark, d)))
register("series_dimension", f"WITH {_GAUGES} SELECT series_key, max(ts_ms) AS last_ts, count(*) AS samples FROM gauges GROUP BY ALL")(lambda spark, d: catalog.series(t.gauges(spark, d)).select("series_key", "last_ts", "samples"))
register("attr_key_cardinality", "SELECT 'svc-' || user_id % 6 AS service, count(DISTINCT event_id % (user_id % 6 + 2)) AS keys FROM events GROUP BY ALL")(
    lambda spark, d: catalog.attr_key_cardinality(
        t.read(spark, d, "events").select(F.concat(F.lit("svc-"), F.col("user_id") % 6).alias("service"), F.array(F.struct(F.concat(F.lit("k"), F.expr("event_id % (user_id % 6 + 2)")).alias("key"), F.lit("").alias("value"))).alias("attrs"))
    )
)

_SAMPLE = "series_key, ts_ms, value"


def _select_query(name: str, selector: str, where: str, options: metrics.Options = metrics.Options()) -> None:
    register(name, f"WITH {_GAUGES} SELECT {_SAMPLE} FROM gauges WHERE {where}")(lambda spark, d: metrics.select(t.gauges(spark, d), selectors.Selector.parse(selector), options).select("series_key", "ts_ms", "value"))


_select_query("select_series", 'event_value{event_type="click"}', "event_type = 'click'")
_select_query("select_regex", 'event_value{event_type=~"r",user_bucket=~"[1-3]"}', "event_type LIKE '%r%' AND user_bucket IN ('1', '2', '3')")
_select_query("select_negative", 'event_value{event_type!="view",user_bucket!~"^[04]$",nowhere!="x"}', "event_type <> 'view' AND user_bucket NOT IN ('0', '4')")
_select_query("select_missing", 'event_value{nowhere="x"}', "false")
_select_query("select_bounds", "event_value", f"ts_ms BETWEEN {T10} AND {T20} AND value BETWEEN 1000 AND 50000", metrics.Options(T10, T20, 1000, 50_000))

_AGGREGATES = "sum(value)::BIGINT AS sum, count(*) AS count, min(value) AS min, max(value) AS max, sum(value)::DOUBLE / count(*) AS avg"
register("sum_by_label", f"WITH {_GAUGES} SELECT event_type AS grp, sum(value)::BIGINT AS value FROM gauges GROUP BY ALL")(lambda spark, d: metrics.sum_by_label(t.gauges(spark, d), GAUGE, "event_type"))
register("sum_of_all", f"WITH {_GAUGES} SELECT '' AS grp, sum(value)::BIGINT AS value FROM gauges WHERE ts_ms BETWEEN {T10} AND {T20}")(lambda spark, d: metrics.sum_by_label(t.gauges(spark, d), GAUGE, "", metrics.Options(T10, T20)))
register("aggregate_by_label", f"WITH {_GAUGES} SELECT user_bucket AS grp, {_AGGREGATES} FROM gauges WHERE ts_ms BETWEEN {T10} AND {T20} GROUP BY ALL")(lambda spark, d: metrics.aggregate_by_label(t.gauges(spark, d), GAUGE, "user_bucket", metrics.Options(T10, T20)))
register("aggregate_zone_maps", f"WITH {_GAUGES} SELECT event_type AS grp, {_AGGREGATES} FROM gauges GROUP BY ALL")(lambda spark, d: metrics.aggregate_zones(metrics.zone_maps(t.gauges(spark, d)), catalog.series(t.gauges(spark, d)), GAUGE, "event_type"))
_ODD = (T10 + 1_234_567, T20 - 7_654_321)
register("aggregate_rolled", f"WITH {_GAUGES} SELECT event_type AS grp, {_AGGREGATES} FROM gauges WHERE ts_ms BETWEEN {_ODD[0]} AND {_ODD[1]} GROUP BY ALL")(
    lambda spark, d: metrics.aggregate_rolled(t.gauges(spark, d), metrics.rollup(t.gauges(spark, d)), GAUGE, "event_type", *_ODD)
)


@register("select_stored", f"WITH {_GAUGES} SELECT series_key, ts_ms, arg_max(value, ingest_seq) AS value, any_value(event_type) AS event_type FROM gauges WHERE event_type LIKE '%r%' AND ts_ms BETWEEN {T10} AND {T20} GROUP BY series_key, ts_ms")
def select_stored(spark: SparkSession, d: str) -> DataFrame:
    """Of two metrics stored by name one, by labels that only the table of series has."""
    samples, series = new_path(spark, "samples"), new_path(spark, "series")
    both = t.gauges(spark, d).unionByName(t.counters(spark, d))
    maintenance.write_compacted(both, samples)
    maintenance.write_series(both, series)
    chosen = metrics.select_stored(spark.read.parquet(samples), spark.read.parquet(series), selectors.Selector.parse('event_value{event_type=~"r"}'), metrics.Options(T10, T20))
    return chosen.select("series_key", "ts_ms", "value", F.col("labels")["event_type"].alias("event_type"))


register("aggregate_missing_label", f"WITH {_GAUGES} SELECT '' AS grp, {_AGGREGATES} FROM gauges")(lambda spark, d: metrics.aggregate_by_label(t.gauges(spark, d), GAUGE, "nowhere"))


def _one_window(where: str, gap: str = "true") -> str:
    return f"""{_COUNTERS}, kept AS (SELECT * FROM counters WHERE {where} QUALIFY row_number() OVER (PARTITION BY series_key, ts_ms ORDER BY ingest_seq DESC) = 1),
lagged AS (SELECT *, lag(ts_ms) OVER w AS prev_ts, value - lag(value) OVER w AS delta FROM kept WINDOW w AS (PARTITION BY series_key ORDER BY ts_ms)),
sums AS (
  SELECT series_key, event_type, user_bucket, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, arg_min(value, ts_ms) AS first_value, arg_max(value, ts_ms) AS last_value,
    sum(greatest(coalesce(delta, 0), 0))::BIGINT AS increase, count(*) FILTER (delta < 0) AS resets, count(*) AS samples, max(ts_ms - prev_ts) AS gap
  FROM lagged GROUP BY ALL HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms) AND {gap})"""


_IN_RANGE = f"ts_ms BETWEEN {T10} AND {T20}"
_RANGE = metrics.Options(T10, T20)


def _rounded() -> Column:
    return F.round("value", 6).alias("value")


register("rate_by_label", f"WITH {_one_window(_IN_RANGE)} SELECT event_type AS grp, round(sum(increase / ((last_ts - first_ts) / 1000.0::DOUBLE)), 6) AS value FROM sums GROUP BY ALL")(lambda spark, d: metrics.rate_by_label(t.counters(spark, d), COUNTER, "event_type", _RANGE).select("grp", _rounded()))
register("rate_gap", f"WITH {_one_window(_IN_RANGE, f'max(ts_ms - prev_ts) <= {3 * DAY_MS}')} SELECT user_bucket AS grp, round(sum(increase / ((last_ts - first_ts) / 1000.0::DOUBLE)), 6) AS value FROM sums GROUP BY ALL")(
    lambda spark, d: metrics.rate_by_label(t.counters(spark, d), COUNTER, "user_bucket", metrics.Options(T10, T20, max_gap_ms=3 * DAY_MS)).select("grp", _rounded())
)
register("rate_value_bounds", f"WITH {_one_window(_IN_RANGE + ' AND value >= 100000')} SELECT event_type AS grp, round(sum(increase / ((last_ts - first_ts) / 1000.0::DOUBLE)), 6) AS value FROM sums GROUP BY ALL")(
    lambda spark, d: metrics.rate_by_label(t.counters(spark, d), COUNTER, "event_type", metrics.Options(T10, T20, min_value=100_000)).select("grp", _rounded())
)
register("increase_by_label", f"WITH {_one_window(_IN_RANGE)} SELECT event_type AS grp, sum(increase)::BIGINT AS value FROM sums GROUP BY ALL")(lambda spark, d: metrics.increase_by_label(t.counters(spark, d), COUNTER, "event_type", _RANGE))
register("rate_summaries", f"WITH {_one_window('true')} SELECT series_key, first_ts, last_ts, first_value, last_value, increase, resets, samples, round(increase / ((last_ts - first_ts) / 1000.0::DOUBLE), 6) AS rate FROM sums")(
    lambda spark, d: metrics.rate_summaries(t.counters(spark, d), COUNTER).select("series_key", "first_ts", "last_ts", "first_value", "last_value", "increase", F.col("resets").cast("bigint").alias("resets"), "samples", F.round("rate", 6).alias("rate"))
)


@register("rate_summaries_merged", f"WITH {_one_window('true')} SELECT series_key, increase, resets, samples FROM sums")
def rate_summaries_merged(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of two halves of each series, merged, are those of the whole."""
    rows = metrics._with_previous(t.counters(spark, d)).withColumn("half", F.ntile(2).over(metrics.Window.partitionBy("series_key").orderBy("ts_ms")))
    same = F.lag("half").over(metrics.Window.partitionBy("series_key").orderBy("ts_ms")) == F.col("half")
    parts = metrics._summaries(rows.withColumn("same", same), ["series_key", "half"], F.coalesce(F.col("same"), F.lit(False)), None)
    return metrics.merge_rate_summaries(parts).select("series_key", "increase", F.col("resets").cast("bigint").alias("resets"), "samples")


_WINDOWED = f"FROM grid JOIN kept ON ts_ms BETWEEN step_ms - {STEPS.window_ms} AND step_ms"


def _kept(table: str) -> str:
    return f"kept AS (SELECT * FROM {table} WHERE ts_ms BETWEEN {STEPS.start_ms - STEPS.window_ms} AND {STEPS.end_ms} QUALIFY row_number() OVER (PARTITION BY series_key, ts_ms ORDER BY ingest_seq DESC) = 1)"


register("aggregate_steps", f"WITH {_GAUGES}, {_GRID}, {_kept('gauges')} SELECT step_ms, event_type AS grp, {_AGGREGATES} {_WINDOWED} GROUP BY ALL")(lambda spark, d: metrics.aggregate_steps(t.gauges(spark, d), GAUGE, "event_type", STEPS))
register("sum_steps", f"WITH {_GAUGES}, {_GRID}, {_kept('gauges')}, s AS (SELECT step_ms, user_bucket AS grp, sum(value)::BIGINT AS value {_WINDOWED} AND event_type = 'click' GROUP BY ALL) SELECT step_ms, grp, value FROM grid LEFT JOIN s USING (step_ms)")(
    lambda spark, d: metrics.sum_steps(t.gauges(spark, d), selectors.Selector.parse('event_value{event_type="click"}'), "user_bucket", STEPS, with_empty=True)
)


def _step_sums(gap: str = "true") -> str:
    return f"""{_COUNTERS}, {_GRID}, {_kept("counters")},
windows AS (SELECT step_ms, series_key, event_type, ts_ms, ts_ms - lag(ts_ms) OVER w AS gap, value - lag(value) OVER w AS delta {_WINDOWED} WINDOW w AS (PARTITION BY step_ms, series_key ORDER BY ts_ms)),
sums AS (SELECT step_ms, series_key, event_type, sum(greatest(coalesce(delta, 0), 0))::BIGINT AS increase, (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS seconds FROM windows GROUP BY ALL HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms) AND {gap})"""


register("rate_steps", f"WITH {_step_sums()} SELECT step_ms, event_type AS grp, round(sum(increase / seconds), 6) AS value FROM sums GROUP BY ALL")(lambda spark, d: metrics.rate_steps(t.counters(spark, d), COUNTER, "event_type", STEPS).select("step_ms", "grp", _rounded()))
register("rate_steps_gap", f"WITH {_step_sums('max(gap) <= 21600000')} SELECT step_ms, event_type AS grp, round(sum(increase / seconds), 6) AS value FROM sums GROUP BY ALL")(
    lambda spark, d: metrics.rate_steps(t.counters(spark, d), COUNTER, "event_type", STEPS, metrics.Options(max_gap_ms=21_600_000)).select("step_ms", "grp", _rounded())
)
register("increase_steps", f"WITH {_step_sums()}, s AS (SELECT step_ms, event_type AS grp, sum(increase)::BIGINT AS value FROM sums GROUP BY ALL) SELECT step_ms, grp, value FROM grid LEFT JOIN s USING (step_ms)")(
    lambda spark, d: metrics.increase_steps(t.counters(spark, d), COUNTER, "event_type", STEPS, with_empty=True)
)
register(
    "zone_maps",
    f"""WITH {_COUNTERS}, lagged AS (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY ts_ms, ingest_seq) AS prev FROM counters)
SELECT series_key, min(value) AS min, max(value) AS max, sum(value)::BIGINT AS sum, count(*) AS count, arg_min(value, (ts_ms, ingest_seq)) AS first, arg_max(value, (ts_ms, ingest_seq)) AS last, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts,
  bool_and(coalesce(value >= prev, true)) AS monotonic, NOT bool_and(coalesce(value >= prev, true)) AS has_reset FROM lagged GROUP BY series_key""",
)(lambda spark, d: metrics.zone_maps(t.counters(spark, d)))
register(
    "aggregate_buckets",
    f"""WITH {_GAUGES}, placed AS (SELECT *, (row_number() OVER (PARTITION BY series_key ORDER BY ts_ms, ingest_seq) - 1) // 64 AS bucket FROM gauges)
SELECT series_key, bucket, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, sum(value)::BIGINT AS sum, count(*) AS count, min(value) AS min, max(value) AS max FROM placed GROUP BY ALL""",
)(lambda spark, d: metrics.aggregate_buckets(t.gauges(spark, d)))

_VALUES = f"""vals AS (SELECT event_type, {_US} // 86400000000 AS day, value - 100.003::DOUBLE AS v FROM events),
scaled AS (SELECT *, CASE WHEN day % 2 = 1 THEN 2 ELSE 3 END AS scale, CASE WHEN abs(v) <= 1 THEN 0 ELSE sign(v)::INTEGER END AS sgn FROM vals),
fine AS (SELECT *, CASE WHEN sgn <> 0 THEN ceil(log2(abs(v)) * (1 << scale))::INTEGER - 1 ELSE 0 END AS idx FROM scaled)"""


def _exp_sql(q: float, group: str) -> str:
    return f"""WITH {_VALUES}, coarse AS (SELECT {group} AS grp, min(scale) AS s FROM fine GROUP BY ALL),
b AS (SELECT c.grp, s, sgn, CASE WHEN sgn = 0 THEN 0 ELSE idx >> (scale - s) END AS i, count(*) AS n FROM fine JOIN coarse c ON c.grp = {group} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY CASE sgn WHEN 0 THEN 0 ELSE sgn * (1000000 + i) END) AS cum, sum(n) OVER (PARTITION BY grp) AS total FROM b)
SELECT grp, round(arg_min(CASE sgn WHEN 0 THEN 0 ELSE sgn * pow(2.0, (i + 0.5) * pow(2.0, -s)) END, cum), 6) AS value FROM r WHERE cum >= {q} * total GROUP BY grp"""


EXP, EXPLICIT = selectors.Selector.parse("event_duration"), selectors.Selector.parse("event_size")
register("exp_quantile", _exp_sql(0.5, "''"))(lambda spark, d: histograms.exp_quantile(histograms.within(t.exp_histograms(spark, d), EXP), 0.5).select("grp", _rounded()))
register("exp_quantile_by", _exp_sql(0.95, "event_type"))(lambda spark, d: histograms.exp_quantile(histograms.within(t.exp_histograms(spark, d), EXP), 0.95, "event_type").select("grp", _rounded()))
register("exp_quantile_low", _exp_sql(0.05, """'"event_type"="' || event_type || '"'"""))(lambda spark, d: histograms.exp_quantile(histograms.within(t.exp_histograms(spark, d), EXP), 0.05, ["event_type"]).select("grp", _rounded()))
register(
    "exp_buckets",
    f"""WITH {_VALUES}, coarse AS (SELECT event_type AS grp, min(scale) AS scale FROM fine GROUP BY ALL)
SELECT c.grp, c.scale::INTEGER AS scale, sgn AS sign, (CASE WHEN sgn = 0 THEN 0 ELSE idx >> (f.scale - c.scale) END)::INTEGER AS index, count(*)::BIGINT AS n FROM fine f JOIN coarse c ON c.grp = f.event_type GROUP BY ALL""",
)(lambda spark, d: histograms.exp_buckets(t.exp_histograms(spark, d), "event_type"))
_BOUNDS = "[" + ", ".join(f"{b}::DOUBLE" for b in t.BOUNDS) + "]"


def _explicit_sql(q: float, group: str) -> str:
    return f"""WITH vals AS (SELECT {group} AS grp, value AS v, len(list_filter({_BOUNDS}, lambda b: b < value)) AS i FROM events),
b AS (SELECT grp, i, count(*) AS n FROM vals GROUP BY ALL), e AS (SELECT grp, min(v) AS lo, max(v) AS hi, count(*) AS total FROM vals GROUP BY ALL),
r AS (SELECT b.*, lo, hi, total, sum(n) OVER (PARTITION BY grp ORDER BY i) AS cum FROM b JOIN e USING (grp)),
f AS (SELECT * FROM r WHERE cum >= {q} * total QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i) = 1),
x AS (SELECT *, CASE WHEN i = 0 THEN lo ELSE {_BOUNDS}[i] END AS a, CASE WHEN i = {len(t.BOUNDS)} THEN hi ELSE {_BOUNDS}[i + 1] END AS z FROM f)
SELECT grp, round(a + (z - a) * ({q} * total - (cum - n)) / n, 6) AS value FROM x"""


register("explicit_quantile", _explicit_sql(0.9, "''"))(lambda spark, d: histograms.explicit_quantile(histograms.within(t.explicit_histograms(spark, d), EXPLICIT), 0.9).select("grp", _rounded()))
register("explicit_quantile_by", _explicit_sql(0.5, "event_type"))(lambda spark, d: histograms.explicit_quantile(histograms.within(t.explicit_histograms(spark, d), EXPLICIT), 0.5, "event_type").select("grp", _rounded()))
register("explicit_buckets", f"SELECT event_type AS grp, len(list_filter({_BOUNDS}, lambda b: b < value))::INTEGER AS i, count(*)::BIGINT AS n FROM events GROUP BY ALL")(lambda spark, d: histograms.explicit_merge(t.explicit_histograms(spark, d), "event_type").filter("n > 0").select("grp", "i", "n"))
register("histogram_summary", "SELECT event_type AS grp, round(sum(value) + sum(value - 100.003::DOUBLE), 4) AS sum, 2 * count(*)::BIGINT AS count, least(min(value), min(value - 100.003::DOUBLE)) AS min, max(value) AS max FROM events GROUP BY ALL")(
    lambda spark, d: histograms.summary_of_both(t.exp_histograms(spark, d), t.explicit_histograms(spark, d), "event_type").withColumn("sum", F.round("sum", 4))
)
register("histogram_synopses", f"SELECT '\"__name__\"=\"event_size\",\"event_type\"=\"' || event_type || '\"' AS series_key, count(DISTINCT {_US} // 86400000000) AS ticks, count(*)::BIGINT AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")(
    lambda spark, d: histograms.synopses(t.explicit_histograms(spark, d)).select("series_key", "ticks", "count", F.round("sum", 4).alias("sum"), "min", "max")
)

register("level_parse", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' THEN 'WARN' ELSE 'INFO' END AS level FROM events")(
    lambda spark, d: t.read(spark, d, "events").select("event_id", fn.parse_level(F.when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))).alias("level"))
)
register("severity_level", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE ['INFO','TRACE','DEBUG','INFO','WARN','ERROR','FATAL'][CASE WHEN event_id % 25 = 0 THEN 1 ELSE ((event_id % 25 - 1) // 4 + 2)::INTEGER END] END AS level FROM events")(
    lambda spark, d: t.read(spark, d, "events").select("event_id", fn.severity_level(F.col("event_type"), F.col("event_id") % 25).alias("level"))
)
register("series_keys", f"WITH {_GAUGES} SELECT DISTINCT series_key FROM gauges")(lambda spark, d: t.gauges(spark, d).select("series_key").distinct())
register("duration_bucket", f"WITH {_SPANS} SELECT id, length(bin(greatest(end_ns - start_ns, 1)))::INTEGER - 1 AS bucket FROM spans")(lambda spark, d: t.spans(spark, d).select(F.lower(F.hex("id")).alias("id"), fn.duration_bucket(fn.duration_ns()).alias("bucket")))
register("scaled_values", "SELECT event_id, round(value * 1000)::BIGINT AS scaled FROM events")(lambda spark, d: t.read(spark, d, "events").select("event_id", fn.scaled_value(F.col("value")).alias("scaled")))
register("display_fields", f"WITH {_LOGS} SELECT id, CASE WHEN length(body) > 10 THEN substr(body, 1, 9) || '…' ELSE body END AS body, substr(trace_id, 1, 8) AS trace FROM logs")(
    lambda spark, d: t.logs(spark, d).select(F.lower(F.hex("id")).alias("id"), fn.truncated(F.col("body"), 10).alias("body"), fn.short_id(F.col("trace_id")).alias("trace"))
)

_REWRITES = "repeated AS (SELECT series_key, ts_ms // 3600000 * 3600000 AS ts_ms, value, ingest_seq FROM gauges)"


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """Gauges at whole hours, so that many samples share series and time."""
    return t.gauges(spark, d).withColumn("ts_ms", F.expr("ts_ms div 3600000 * 3600000"))


register("compact_dedupe", f"WITH {_GAUGES}, {_REWRITES} SELECT series_key, ts_ms, arg_max(value, ingest_seq) AS value, max(ingest_seq) AS ingest_seq FROM repeated WHERE ts_ms >= {T10} GROUP BY ALL")(
    lambda spark, d: maintenance.compact_samples(_hourly(spark, d), T10).select("series_key", "ts_ms", "value", "ingest_seq")
)
register("aggregate_steps_repeated", f"WITH {_GAUGES}, {_REWRITES}, {_GRID}, {_kept('repeated')} SELECT step_ms, '' AS grp, {_AGGREGATES} {_WINDOWED} GROUP BY ALL")(lambda spark, d: metrics.aggregate_steps(_hourly(spark, d), GAUGE, "", STEPS))
register("compact_histograms", f"SELECT event_type, count(DISTINCT {_US} // 86400000000) AS ticks FROM events WHERE {_US} // 86400000000 * 86400000 >= {T10} GROUP BY event_type")(
    lambda spark, d: maintenance.compact_histograms(t.explicit_histograms(spark, d), T10).groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("ticks"))
)
_SEGMENTS = "segs AS (SELECT o_custkey % 97 AS segment_id, max(epoch_us(o_orderdate)) * 1000 AS max_ts, count(*) AS size_bytes, o_custkey % 97 = 13 AS pending FROM orders GROUP BY ALL)"
RETENTION, RETENTION_NOW = maintenance.Retention(30 * DAY_NS, 60, 500), 0


def _order_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = t.read(spark, d, "orders")
    return rows.groupBy((F.col("o_custkey") % 97).alias("segment_id")).agg((F.max(t.epoch_us(F.col("o_orderdate"))) * 1000).alias("max_ts"), F.count("*").alias("size_bytes")).withColumn("delete_pending", F.col("segment_id") == 13)


@register(
    "retention_select",
    f"""WITH {_SEGMENTS}, a AS (SELECT *, CASE WHEN pending THEN 'delete_pending' WHEN max_ts < 902188800000000000 THEN 'max_age' END AS r FROM segs),
rest AS (SELECT *, row_number() OVER w AS place, sum(size_bytes) OVER w AS bytes FROM a WHERE r IS NULL WINDOW w AS (ORDER BY max_ts DESC, segment_id DESC))
SELECT segment_id, r AS reason FROM a WHERE r IS NOT NULL UNION ALL SELECT segment_id, CASE WHEN place > 60 THEN 'max_segments' ELSE 'max_total_bytes' END FROM rest WHERE place > 60 OR bytes > 500""",
)
def retention_select(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.select_for_deletion(_order_segments(spark, d), RETENTION, 902188800000000000 + RETENTION.max_age_ns)


COLD_NOW, COLD_MS = 1_706_659_200_000, 8 * 3_600_000
register("cold_series", f"SELECT '\"u\"=\"' || user_id % 500 || '\"' AS series_key, max({_US} // 1000) AS last_ts FROM events WHERE {_US} // 1000 <= {COLD_NOW} GROUP BY ALL HAVING max({_US} // 1000) <= {COLD_NOW - COLD_MS}")(
    lambda spark, d: maintenance.cold_series(
        t.read(spark, d, "events").select(F.concat(F.lit('"u"="'), F.col("user_id") % 500, F.lit('"')).alias("series_key"), F.floor(t.epoch_us(F.col("ts")) / 1000).alias("ts_ms")).filter(F.col("ts_ms") <= COLD_NOW), COLD_NOW, COLD_MS
    )
)
register("expired_blocks", f"SELECT series_key, max_ts FROM (SELECT user_id % 500 AS series_key, max({_US} // 1000) AS max_ts FROM events GROUP BY ALL) WHERE max_ts < {COLD_NOW - DAY_MS}")(
    lambda spark, d: maintenance.expired_blocks(t.read(spark, d, "events").groupBy((F.col("user_id") % 500).alias("series_key")).agg(F.floor(F.max(t.epoch_us(F.col("ts"))) / 1000).alias("max_ts")), COLD_NOW - DAY_MS)
)


def _otlp_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an OTLP request for logs; those of user 3 have a trace id that isn't one."""
    e = t.read(spark, d, "events")
    text = lambda v: F.struct(v.cast("string").alias("stringValue"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), text(v).alias("value"))
    record = F.struct(
        (t.epoch_us(F.col("ts")) * 1000).cast("string").alias("timeUnixNano"), F.col("event_type").alias("severityText"), (F.col("event_id") % 25).cast("int").alias("severityNumber"), text(F.col("event_type")).alias("body"),
        F.array(pair("value", F.col("user_id"))).alias("attributes"), F.when(F.col("user_id") == 3, "xyz").otherwise(t.padded_hex(F.col("user_id") + 1, 32)).alias("traceId"),
    )
    group = F.struct(F.struct(F.array(pair("service.name", F.lit("old")), pair("service.name", F.concat(F.lit("svc-"), (F.col("user_id") % 6).cast("string")))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))
    return e.select(F.to_json(F.struct(F.array(group).alias("resourceLogs"))).alias("json"))


@register(
    "otlp_logs",
    f"""SELECT {_US} * 1000 AS ts_ns, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE ['INFO','TRACE','DEBUG','INFO','WARN','ERROR','FATAL'][CASE WHEN event_id % 25 = 0 THEN 1 ELSE ((event_id % 25 - 1) // 4 + 2)::INTEGER END] END AS level,
  'svc-' || user_id % 6 AS service, CASE WHEN user_id <> 3 THEN lpad(lower(to_hex(user_id + 1)), 32, '0') END AS trace_id, event_type AS body, user_id::VARCHAR AS value, CASE WHEN user_id = 3 THEN 'trace_id' END AS reject FROM events""",
)
def otlp_logs(spark: SparkSession, d: str) -> DataFrame:
    return otlp.logs(_otlp_requests(spark, d)).select("ts_ns", "level", "service", "trace_id", "body", F.col("attrs")[0]["value"].alias("value"), "reject")


def _otlp_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an OTLP request for a sum: of views not monotonic, of clicks delta, else cumulative."""
    e = t.read(spark, d, "events")
    pair = F.struct(F.lit("event_type").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value"))
    point = F.struct((t.epoch_us(F.col("ts")) * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"), F.array(pair).alias("attributes"))
    total = F.struct(F.when(F.col("event_type") == "click", "1").otherwise("AGGREGATION_TEMPORALITY_CUMULATIVE").alias("aggregationTemporality"), (F.col("event_type") != "view").alias("isMonotonic"), F.array(point).alias("dataPoints"))
    metric = F.struct(F.lit("amount").alias("name"), total.alias("sum"))
    group = F.struct(F.struct(F.array(pair).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
    return e.select(F.to_json(F.struct(F.array(group).alias("resourceMetrics"))).alias("json"))


@register(
    "otlp_samples",
    f"""SELECT '"__name__"="amount","__scale__"="1000","event_type"="' || event_type || '","resource.event_type"="' || event_type || '"' AS series_key, 'counter' AS type, {_US} // 1000 AS ts_ms, {_SCALED} AS value,
  CASE WHEN event_type IN ('view', 'click') THEN 'sum_temporality' END AS reject FROM events""",
)
def otlp_samples(spark: SparkSession, d: str) -> DataFrame:
    return otlp.samples(_otlp_metrics(spark, d)).select("series_key", "type", "ts_ms", "value", "reject")


def _otlp_points(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each event as an OTLP request for a histogram or summary of one point; of views with delta temporality, of user 3 with a bad count."""
    e = t.read(spark, d, "events")
    text = lambda v: F.struct(v.cast("string").alias("stringValue"))
    fields = {"timeUnixNano": (t.epoch_us(F.col("ts")) * 1000).cast("string"), "attributes": F.array(F.struct(F.lit("id").alias("key"), text(F.col("event_id")).alias("value"))), "sum": F.col("value")}
    count = F.when(F.col("user_id") == 3, "x").otherwise("1")
    if kind == "histogram":
        at = fn.explicit_bucket(F.col("value"), F.array(*[F.lit(b) for b in t.BOUNDS]))
        fields |= {"count": count, "explicitBounds": F.array(*[F.lit(b) for b in t.BOUNDS]), "bucketCounts": F.array(*[F.when(at == i, "1").otherwise("0") for i in range(len(t.BOUNDS) + 1)])}
    elif kind == "exponentialHistogram":
        side = lambda n: F.struct((F.col("event_id") % 7 - 3).cast("int").alias("offset"), F.array(F.lit("0"), F.lit(n)).alias("bucketCounts"))
        fields |= {"count": count, "scale": F.lit(3), "zeroCount": F.lit("2"), "positive": side("1"), "negative": side("4")}
    else:
        pair = lambda q, v: F.struct(F.lit(q).alias("quantile"), v.alias("value"))
        fields |= {"quantileValues": F.array(pair(0.5, F.col("value")), pair(0.9, F.col("value") * 2))}
    point = F.struct(*[c.alias(n) for n, c in fields.items()])
    data = [F.array(point).alias("dataPoints")] + ([] if kind == "summary" else [F.when(F.col("event_type") == "view", "1").otherwise("2").alias("aggregationTemporality")])
    metric = F.struct(F.lit("m").alias("name"), F.struct(*data).alias(kind))
    scopes = F.array(F.struct(F.array().cast(f"array<{e.select(metric.alias('m')).schema['m'].dataType.simpleString()}>").alias("metrics")), F.struct(F.array(metric).alias("metrics")))
    return e.select(F.to_json(F.struct(F.array(F.struct(scopes.alias("scopeMetrics"))).alias("resourceMetrics"))).alias("json"))


_POINT_KEY = """'"__name__"="m","id"="' || event_id || '"' AS series_key"""
_COUNT_REJECT = "CASE WHEN event_type = 'view' THEN '{}' WHEN user_id = 3 THEN 'count' END AS reject"
register(
    "otlp_explicit",
    f"""SELECT {_POINT_KEY}, {_US} // 1000 AS ts_ms, len(list_filter({"[" + ", ".join(f"{b}::DOUBLE" for b in t.BOUNDS) + "]"}, lambda b: b < value))::INTEGER AS bucket, round(value, 6) AS sum, CASE WHEN user_id <> 3 THEN 1::BIGINT END AS count, {_COUNT_REJECT.format("histogram_temporality")} FROM events""",
)(lambda spark, d: otlp.explicit_histograms(_otlp_points(spark, d, "histogram")).select("series_key", "ts_ms", (F.array_position("counts", F.lit(1).cast("bigint")) - 1).cast("int").alias("bucket"), F.round("sum", 6).alias("sum"), "count", "reject"))
register(
    "otlp_exp",
    f"""SELECT {_POINT_KEY}, {_US} // 1000 AS ts_ms, 3 AS scale, 2::BIGINT AS zero_count, (event_id % 7 - 3)::INTEGER AS pos_offset, '0,1' AS pos, '0,4' AS neg, CASE WHEN user_id <> 3 THEN 1::BIGINT END AS count, {_COUNT_REJECT.format("exphistogram_temporality")} FROM events""",
)(
    lambda spark, d: otlp.exp_histograms(_otlp_points(spark, d, "exponentialHistogram")).select(
        "series_key", "ts_ms", "scale", "zero_count", F.col("pos.offset").alias("pos_offset"), F.array_join(F.col("pos.counts").cast("array<string>"), ",").alias("pos"), F.array_join(F.col("neg.counts").cast("array<string>"), ",").alias("neg"), "count", "reject"
    )
)
register(
    "otlp_summary",
    f"""SELECT '"__name__"="m","__scale__"="1000","id"="' || event_id || '","quantile"="' || q || '"' AS series_key, {_US} // 1000 AS ts_ms, round((CASE q WHEN '0.5' THEN value ELSE value * 2 END) * 1000)::BIGINT AS value FROM events, (VALUES ('0.5'), ('0.9')) x(q)""",
)(lambda spark, d: otlp.summary_samples(_otlp_points(spark, d, "summary")).select("series_key", "ts_ms", "value"))
register("otlp_unsupported", "SELECT 'histogram_temporality' AS reason, count(*) AS points FROM events WHERE event_type = 'view'")(lambda spark, d: otlp.unsupported(_otlp_points(spark, d, "histogram")))


@register(
    "otlp_spans",
    f"""WITH {_SPANS} SELECT nullif(trace_id, repeat('0', 32)) AS trace_id, span_id, CASE WHEN service <> 'svc-4' THEN parent_id END AS parent_id, service, operation, start_ns, end_ns, status,
  CASE WHEN trace_id = repeat('0', 32) THEN 'trace_id' WHEN service = 'svc-4' THEN 'parent_id' END AS reject FROM spans
UNION ALL SELECT NULL, NULL, NULL, '', '', NULL, NULL, 'UNSET', 'json' FROM region""",
)
def otlp_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each span as an OTLP request with an empty scope before its own; one request for each region can't be read."""
    code = F.when(F.col("status") == "ERROR", "2").when(F.col("status") == "OK", "STATUS_CODE_OK").otherwise("0")
    span = F.struct(
        F.upper("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.when(F.col("service") == "svc-4", "no id").otherwise(F.col("parent_id")).alias("parentSpanId"), F.col("operation").alias("name"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), F.struct(code.alias("code")).alias("status"),
    )
    service = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value")))
    scopes = F.array(F.struct(F.when(F.lit(False), F.array(span)).alias("spans")), F.struct(F.array(span).alias("spans")))
    requests = t.spans(spark, d).select(F.to_json(F.struct(F.array(F.struct(F.struct(service.alias("attributes")).alias("resource"), scopes.alias("scopeSpans"))).alias("resourceSpans"))).alias("json"))
    requests = requests.union(t.read(spark, d, "region").select(F.lit('{"resourceSpans": [')))
    found = otlp.spans(requests)
    when = lambda c: F.when(F.col("reject") == "json", None).otherwise(F.col(c)).alias(c)
    return found.select("trace_id", "span_id", "parent_id", "service", "operation", when("start_ns"), when("end_ns"), "status", "reject")


@register(
    "native_logs",
    """SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'svc-' || user_id % 6 AS service, event_type AS body, user_id::VARCHAR AS value, CASE WHEN user_id = 3 THEN 'trace_id' END AS reject FROM events""",
)
def native_logs(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a request of one plain entry; those of user 3 have a trace id that isn't one."""
    entry = F.struct(
        F.col("event_type").alias("level"), F.concat(F.lit("svc-"), F.col("user_id") % 6).alias("service"), F.col("event_type").alias("body"), F.when(F.col("user_id") == 3, "xyz").alias("trace_id"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attrs")
    )
    requests = t.read(spark, d, "events").select(F.to_json(F.array(entry)).alias("json"))
    return native.logs(requests).select("level", "service", "body", F.col("attrs")[0]["value"].alias("value"), "reject")


register("span_status", "SELECT event_id, ['UNSET', 'OK', 'ERROR', 'UNSET'][event_id % 4 + 1] AS status FROM events")(lambda spark, d: t.read(spark, d, "events").select("event_id", fn.span_status(F.col("event_id") % 4).alias("status")))
register("entry_ids", f"SELECT event_id, {_US} // 1000 AS ms, 32 AS digits FROM events")(
    lambda spark, d: t.read(spark, d, "events").select("event_id", fn.new_entry_id(F.floor(t.epoch_us(F.col("ts")) / 1000)).alias("i")).select("event_id", fn.entry_id_ms(F.col("i")).alias("ms"), F.length(F.hex("i")).alias("digits"))
)
register("journal_expired", f"WITH {_SEGMENTS} SELECT segment_id, CASE WHEN pending THEN 'delete_pending' ELSE 'max_segments' END AS reason FROM segs QUALIFY pending OR row_number() OVER (PARTITION BY pending ORDER BY max_ts DESC, segment_id DESC) > 50")(
    lambda spark, d: journal.expired(_order_segments(spark, d), maintenance.Retention(max_segments=50), 0)
)


@register("copy_restore", "SELECT true AS same, count(*) AS records FROM events")
def copy_restore(spark: SparkSession, d: str) -> DataFrame:
    """A table copied, restored from the copy, and all three compared."""
    rows, folder = t.logs(spark, d), new_path(spark, "drill")
    same = maintenance.drill(rows, folder)
    return spark.read.parquet(f"{folder}/restored").agg(F.lit(same).alias("same"), F.count("*").alias("records"))


@register("write_compacted", f"WITH {_GAUGES}, {_REWRITES} SELECT 'event_value' AS metric_name, series_key, ts_ms, arg_max(value, ingest_seq) AS value FROM repeated WHERE ts_ms >= {T10} GROUP BY series_key, ts_ms")
def write_compacted(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "samples")
    maintenance.write_compacted(_hourly(spark, d), path, T10)
    return spark.read.parquet(path).select("metric_name", "series_key", "ts_ms", "value")


@register("rewrite_histograms", f"SELECT event_type, count(DISTINCT {_US} // 86400000000) AS ticks, count(*)::BIGINT AS count, round(sum(value), 4) AS sum FROM events WHERE {_US} // 86400000000 * 86400000 >= {T10} GROUP BY event_type")
def rewrite_histograms(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "histograms")
    maintenance.rewrite_histograms(t.explicit_histograms(spark, d), path, T10)
    return spark.read.parquet(path).groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("ticks"), F.sum("count").alias("count"), F.round(F.sum("sum"), 4).alias("sum"))


@register("stored_day_range", f"WITH {_LOGS} SELECT {', '.join(LOG_COLUMNS)} FROM logs WHERE ts_ns BETWEEN {T10 * 1_000_000} AND {(T10 + DAY_MS) * 1_000_000}")
def stored_day_range(spark: SparkSession, d: str) -> DataFrame:
    """Logs of a time range from a stored table with a part that isn't stored yet."""
    tables = store.StoredTables(new_path(spark, "store"))
    old, new = t.logs(spark, d).filter("ingest_seq % 5 <> 0"), t.logs(spark, d).filter("ingest_seq % 5 = 0")
    tables.append("logs", old)
    rows = store.with_head(spark.read.parquet(f"{tables.path}/logs"), new)
    return _shown(search.matching(rows, search.LogQuery(start_ns=T10 * 1_000_000, end_ns=(T10 + DAY_MS) * 1_000_000)), LOG_COLUMNS)


register("attribute_limits", f"WITH {_LOGS} SELECT id, CASE WHEN length(event_type) > 5 THEN 'attr_value_too_long' END AS reject FROM logs")(
    lambda spark, d: t.logs(spark, d).select(F.lower(F.hex("id")).alias("id"), ingest.Guard(max_attrs=2, max_value_bytes=5).static_reject().alias("reject"))
)
register("series_limits", f"WITH {_GAUGES}, k AS (SELECT DISTINCT series_key FROM gauges ORDER BY 1 LIMIT 25) SELECT series_key, ts_ms, CASE WHEN series_key NOT IN (SELECT series_key FROM k) THEN 'series' END AS reject FROM gauges")(
    lambda spark, d: ingest.series_rejects(t.gauges(spark, d), t.gauges(spark, d).select("series_key").limit(0), 25).select("series_key", "ts_ms", "reject")
)
register("generated_logs", "SELECT range AS ingest_seq, 1000000000 + range * 1000 AS ts_ns FROM range(5000)")(lambda spark, d: native.generated_logs(spark, 5000, 1_000_000_000, 5_000_000).select("ingest_seq", "ts_ns"))


@register("stream_ingest", f"WITH {_LOGS} SELECT level, count(*) AS records, min(ts_ns) AS first_ts_ns FROM logs WHERE trace_id <> '{4:032x}' GROUP BY level")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """OTLP request files read as a stream and stored, rejects apart."""
    source, table, state = (new_path(spark, n) for n in ("requests", "stored", "state"))
    _otlp_requests(spark, d).write.text(source)
    stream = spark.readStream.schema("value string").text(source).withColumnRenamed("value", "json")
    ingest.start_ingest(otlp.logs(stream), table, state).awaitTermination()
    stored = spark.read.parquet(table)
    level = F.when(F.col("body") == "error", "ERROR").when(F.col("body") == "signup", "WARN").when(F.col("body") == "purchase", "INFO").when(F.col("body") == "click", "DEBUG").otherwise("TRACE")
    return stored.groupBy(level.alias("level")).agg(F.count("*").alias("records"), F.min("ts_ns").alias("first_ts_ns"))


@register("stream_tail", f"WITH {_LOGS} SELECT id, ts_ns, level FROM logs WHERE level = 'ERROR'")
def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """A live tail of stored logs in which every file arrives twice."""
    source, out, state = (new_path(spark, n) for n in ("logs", "tail", "state"))
    for _ in range(2):
        t.logs(spark, d).write.mode("append").parquet(source)
    stream = spark.readStream.schema(t.logs(spark, d).schema).parquet(source)
    found = ingest.tail(stream, search.LogQuery(levels=["ERROR"]), "100 days")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select(F.lower(F.hex("id")).alias("id"), "ts_ns", "level")


@register("cardinality_guard", f"WITH {_LOGS} SELECT service, count(*) AS records, count(*) FILTER (length(event_type) > 6) AS rejected FROM logs GROUP BY service")
def cardinality_guard(spark: SparkSession, d: str) -> DataFrame:
    """Records with three keys where a service may have two; known keys pass, in a batch as in a stream."""
    rows = t.logs(spark, d).withColumn("attrs", F.when(F.length(F.col("attrs")[1]["value"]) > 6, F.concat("attrs", F.array(F.struct(F.lit("third").alias("key"), F.lit("x").alias("value"))))).otherwise(F.col("attrs")))
    guard = ingest.Guard(max_keys_per_service=2)
    source, out, state = (new_path(spark, n) for n in ("records", "guarded", "state"))
    rows.select("service", "attrs").write.parquet(source)
    stream = spark.readStream.schema(rows.select("service", "attrs").schema).parquet(source)
    ingest.guard_keys(stream, guard).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("service").agg(F.count("*").alias("records"), F.count_if(F.col("reject").isNotNull()).alias("rejected"))


@register("guarded_batch", f"WITH {_LOGS}, k AS (SELECT DISTINCT service FROM logs ORDER BY 1 LIMIT 4) SELECT service, count(*) AS records, count(*) FILTER (service NOT IN (FROM k)) AS rejected FROM logs GROUP BY service")
def guarded_batch(spark: SparkSession, d: str) -> DataFrame:
    """Of six services four may have records, each with two attribute keys."""
    rows = t.logs(spark, d).select("service", "attrs", F.lit(None).cast("string").alias("reject"))
    checked, _ = ingest.guard_batch(rows, spark.createDataFrame([], ingest.KEYS), ingest.Guard(max_keys_per_service=2, max_services=4))
    return checked.groupBy("service").agg(F.count("*").alias("records"), F.count_if(F.col("reject").isNotNull()).alias("rejected"))


@register("journal_replay", f"WITH {_LOGS} SELECT ts_ns AS accepted_at, 'logs' AS signal, id, body FROM logs")
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Logs written to the journal and read back from it."""
    path = new_path(spark, "journal")
    journal.append(journal.normalised(t.logs(spark, d), "logs", "ts_ns"), path)
    body = F.from_json("payload", "id string, body string")
    return journal.replay(spark, path, "logs").select("accepted_at", "signal", F.lower(body["id"]).alias("id"), body["body"].alias("body"))


register("journal_subset", f"WITH {_LOGS} SELECT id, level FROM logs WHERE span_id IS NULL OR level <> 'ERROR'")(
    lambda spark, d: _shown(journal.subset(t.logs(spark, d), t.logs(spark, d).filter("level = 'ERROR' AND span_id IS NOT NULL"), "id", excluding=True), ["id", "level"])
)


@register("segment_round_trip", f"WITH {_LOGS} SELECT count(*) AS records, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM logs")
def segment_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Logs stored by day and read back, their files as the catalog sees them."""
    path = new_path(spark, "segments")
    maintenance.write_segments(t.logs(spark, d), path)
    files = catalog.segments(spark.read.parquet(path))
    return files.agg(F.sum("records").alias("records"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
