import json

import pytest
from pyspark.sql import functions as F

from tarnlight.functions.tokens import has_all_tokens, query_tokens, stem, stemmed_tokens, tokens
from tarnlight.operators.search import Cursor, LogQuery, QueryError, SpanQuery, fetch_page, ndjson, search_logs, search_spans
from tarnlight.schema import LOGS, SPANS

BASE = 1_767_323_045_000_000_000
BODIES = ["payment timeout database", "payment accepted", "cache timeout recovered", "healthy request"]


@pytest.fixture(scope="module")
def tables(spark):
    logs, spans = [], []
    for i in range(120):
        ts, entry = BASE + i * 10**9, (i + 1).to_bytes(16, "big")
        trace = f"{i % 4 + 1:02x}" + "0" * 28 + f"{0xA0 + i % 4:02x}"
        attrs = [("env", ["prod", "stage"][i % 2]), ("shard", str(i % 5))]
        logs.append((entry, ts, None, ["DEBUG", "INFO", "WARN", "ERROR"][i % 4], f"svc-{i % 3}", f"host-{i % 2}", trace, None, BODIES[i % 4], attrs, i))
        spans.append((entry, trace, f"{i + 1:016x}", None if i % 2 == 0 else "f" * 16, f"svc-{i % 3}", f"op-{i % 4}", ts, ts + [1, 7, 50, 500][i % 4] * 10**6, ["UNSET", "OK", "ERROR"][i % 3], attrs, i))
    return spark.createDataFrame(logs, LOGS), spark.createDataFrame(spans, SPANS), logs, spans


def newest(rows, keep, limit, ts):
    return [r[0] for r in sorted((r for r in rows if keep(r)), key=lambda r: (r[ts], r[0]), reverse=True)][:limit]


@pytest.mark.parametrize(
    "query, keep",
    [
        (LogQuery(limit=7), lambda r: True),
        (LogQuery(services=["svc-0", "svc-2"], limit=19), lambda r: r[4] in ("svc-0", "svc-2")),
        (LogQuery(hosts=["host-1"], levels=["WARN", "ERROR"], limit=13), lambda r: r[5] == "host-1" and r[3] in ("WARN", "ERROR")),
        (LogQuery(attrs={"env": "prod", "shard": "2"}, limit=11), lambda r: r[9] == [("env", "prod"), ("shard", "2")]),
        (LogQuery(text="timeout", limit=17), lambda r: "timeout" in r[8]),
        (LogQuery(text="timeout PAYMENT", limit=9), lambda r: "payment" in r[8] and "timeout" in r[8]),
        (LogQuery(trace_id="02" + "0" * 28 + "a1", limit=8), lambda r: r[6].startswith("02")),
        (LogQuery(trace_id="0" * 32, limit=8), lambda r: True),
        (LogQuery(start_ns=BASE + 23 * 10**9, end_ns=BASE + 87 * 10**9, services=["svc-1"], text="payment", limit=6), lambda r: BASE + 23 * 10**9 <= r[1] <= BASE + 87 * 10**9 and r[4] == "svc-1" and "payment" in r[8]),
    ],
)
def test_log_queries(tables, query, keep):
    logs, _, rows, _ = tables
    want = newest(rows, keep, query.limit, 1)
    assert [bytes(r.id) for r in search_logs(logs, query).collect()] == want
    for parts in (1, 7):
        assert [bytes(r.id) for r in search_logs(logs.repartition(parts), query).collect()] == want


@pytest.mark.parametrize(
    "query, keep",
    [
        (SpanQuery(operations=["op-1", "op-3"], statuses=["OK"], limit=13), lambda r: r[5] in ("op-1", "op-3") and r[8] == "OK"),
        (SpanQuery(min_duration_ns=7 * 10**6, max_duration_ns=50 * 10**6, limit=11), lambda r: 7 * 10**6 <= r[7] - r[6] <= 50 * 10**6),
        (SpanQuery(services=["svc-1"], attrs={"env": "stage"}, min_duration_ns=500 * 10**6, limit=6), lambda r: r[4] == "svc-1" and r[9][0][1] == "stage" and r[7] - r[6] >= 500 * 10**6),
    ],
)
def test_span_queries(tables, query, keep):
    _, spans, _, rows = tables
    assert [bytes(r.id) for r in search_spans(spans, query).collect()] == newest(rows, keep, query.limit, 6)


def test_pages_have_no_gap_and_no_overlap(tables):
    logs, _, rows, _ = tables
    query, seen = LogQuery(limit=17, levels=["INFO", "WARN"]), []
    while True:
        page = fetch_page(logs, query, count_total=True)
        assert page.total == 60
        seen += [bytes(r.id) for r in page.rows]
        if not page.next_cursor:
            break
        query = LogQuery(limit=17, levels=["INFO", "WARN"], cursor=page.next_cursor)
    assert seen == newest(rows, lambda r: r[3] in ("INFO", "WARN"), 1000, 1)


def test_event_time_orders_and_ids_break_ties(spark):
    row = lambda i, ts: (i.to_bytes(16, "big"), ts, None, "INFO", "s", "h", None, None, "b", [], i)
    logs = spark.createDataFrame([row(9, BASE), row(1, BASE + 60 * 10**9)], LOGS)
    assert search_logs(logs, LogQuery(limit=1)).first().ingest_seq == 1
    logs = spark.createDataFrame([row(3, BASE), row(300, BASE), row(2, BASE)], LOGS)
    assert [r.ingest_seq for r in search_logs(logs, LogQuery()).collect()] == [300, 3, 2]
    page = fetch_page(logs, LogQuery(limit=3))
    assert page.truncated and fetch_page(logs, LogQuery(limit=3, cursor=page.next_cursor)).rows == []


def test_cursor_and_validation():
    c = Cursor(BASE, bytes(range(16)))
    assert Cursor.decode(c.encode()) == c and "=" not in c.encode()
    for bad in (LogQuery(limit=-1), LogQuery(limit=100_001), LogQuery(start_ns=2, end_ns=1), SpanQuery(cursor="@@"), LogQuery(cursor="AAAA")):
        with pytest.raises(QueryError):
            bad.validate()
    assert LogQuery().validate().limit == 100


def test_full_text(spark):
    bodies = ["connection refused to postgres:5432", "rate limit exceeded ip=10.0.0.1", "request completed ok", "connection refused to redis:6379", "cache warmed successfully", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    count = lambda q: df.filter(has_all_tokens(F.col("body"), q)).count()
    assert [count(q) for q in ("refused", "rate", "nonexistentxyz", "connection refused", "refused rate", "--")] == [2, 1, 0, 2, 0, 0]
    assert [stem(w) for w in ("timeout", "payment", "authorized", "caresses", "relational", "hopping", "sky")] == ["timeout", "payment", "author", "caress", "relat", "hop", "sky"]
    assert query_tokens("payment Authorized payment", stemmed=True) == ["payment", "author"]
    got = spark.createDataFrame([("payment authorized",), (None,)], "b string").select(stemmed_tokens(F.col("b")), tokens(F.col("b"))).collect()
    assert [list(r) for r in got] == [[["payment", "author"], ["payment", "authorized"]], [[], []]]


def test_ndjson(spark):
    logs = spark.createDataFrame([(b"\0" * 16, BASE + 5, None, "INFO", "s", "h", "ab", None, 'say "x"', [("k", "v"), ("level", "mine")], 1)], LOGS).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    line = json.loads(ndjson(logs).first().line)
    assert line == {"_time": "2026-01-02T03:04:05.000000005Z", "level": "mine", "service": "s", "host": "h", "_msg": 'say "x"', "trace_id": "ab", "k": "v"}


def test_pushdown_and_top_k(tables, tmp_path, capsys):
    logs = tables[0]
    logs.write.parquet(str(tmp_path / "logs"))
    stored = logs.sparkSession.read.parquet(str(tmp_path / "logs"))
    search_logs(stored, LogQuery(levels=["ERROR"], start_ns=BASE)).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(ts_ns" in plan and "EqualTo(level,ERROR)" in plan


def test_ndjson_computes_each_field_once_and_keeps_the_last_of_a_key(spark):
    attrs = [("env", "a"), ("level", "mine"), ("env", "b"), (None, "no key"), ("env", "c")]
    row = (bytes(16), BASE, None, "INFO", "svc", "h", None, None, "m", attrs, 1)
    lines = ndjson(spark.createDataFrame([row], LOGS))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("date_format") == 1
    assert json.loads(lines.first().line) == {"_msg": "m", "_time": "2026-01-02T03:04:05Z", "env": "c", "host": "h", "level": "mine", "service": "svc"}
