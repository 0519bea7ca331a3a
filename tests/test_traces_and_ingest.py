import json
import struct

import __spark_entry__
import pyarrow as pa
from pyspark.sql import functions as F

from tarnlight.functions import scalars
from tarnlight.operators import catalog, traces
from tarnlight.operators.search import SpanQuery
from tarnlight.schema import LOGS, SPANS
from tarnlight.sources import journal, native, otlp, otlp_protobuf, paths
from tarnlight.streaming import ingest


def rollup(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0]), reverse=True):
        a = out.setdefault(r[1], [r[6], r[7], 0, False, r[4], r[5]])
        a[0], a[1], a[2], a[3] = min(a[0], r[6]), max(a[1], r[7]), a[2] + 1, a[3] or r[8] == "ERROR"
        if r[3] is None:
            a[4:] = r[4], r[5]
    return out


def test_trace_rollup_against_a_fold(spark):
    rows = []
    for i in range(1500):
        start = 10**18 + i * 10**9
        rows.append((i.to_bytes(16, "big"), f"{i // 5:032x}", f"{i + 1:016x}", None if i % 5 == 0 else f"{i // 5 * 5 + 1:016x}", ["api-gateway", "auth-service", "payment"][i % 3], ["GET /widgets", "POST /orders", "DELETE /sessions"][i % 3], start, start + (i % 7 + 1) * 10**6, ["UNSET", "OK", "ERROR"][i % 3], [], i))
    spans = spark.createDataFrame(rows, SPANS).repartition(4)
    for query, keep in ((SpanQuery(), lambda r: True), (SpanQuery(services=["payment"]), lambda r: r[4] == "payment"), (SpanQuery(services=["payment"], min_duration_ns=3 * 10**6), lambda r: r[4] == "payment" and r[7] - r[6] >= 3 * 10**6)):
        want = rollup(r for r in rows if keep(r))
        got = {r.trace_id: [r.start_ns, r.end_ns, r.span_count, r.has_error, r.root_service, r.root_operation] for r in traces.trace_summaries(spans, query).collect()}
        assert got == want
        page = [r.trace_id for r in traces.trace_summaries(spans, query, 20, 5).collect()]
        assert page == [k for k, _ in sorted(want.items(), key=lambda x: (-x[1][0], x[0]))][5:25]


def test_tree(spark):
    span = lambda s, p, seq=0, op="x": (seq.to_bytes(16, "big"), "t", s, p, "svc", op, 100 + seq, 200, "OK", [], seq)
    rows = [span("a", None), span("b", "a", 1), span("c", "b", 2), span("d", "gone", 3), span("e", "e", 4), span("f", "g", 5), span("g", "f", 6), span("c", "b", 7, "newer")]
    spans = spark.createDataFrame(rows, SPANS)
    tree = {r.span_id: (r.depth, r.path, r.operation) for r in traces.trace_tree(spans).collect()}
    assert tree == {"a": (0, "a", "x"), "b": (1, "a/b", "x"), "c": (2, "a/b/c", "newer"), "d": (0, "d", "x")}
    log = lambda i, s: (bytes([i]) * 16, i, None, "INFO", "svc", "h", "t", s, f"m{i}", [], i)
    logs = spark.createDataFrame([log(2, "b"), log(1, "b"), log(3, "zz"), log(4, None)], LOGS)
    found = {r.span_id: [x.body for x in r.logs] for r in traces.logs_of_spans(spans, logs).collect()}
    assert found["b"] == ["m1", "m2"] and found["a"] == []
    s, logged = traces.lookup_trace(spans, logs, "t", 3, 2)
    assert s.count() == 3 and [r.ingest_seq for r in logged.collect()] == [4, 3]
    assert [r.service for r in catalog.services(logs, spans).collect()] == ["svc"]


def test_tree_of_a_deep_chain(spark):
    rows = [(i.to_bytes(16, "big"), "t", f"{i:03d}", f"{i - 1:03d}" if i else None, "svc", "x", 100 + i, 200, "OK", [], i) for i in range(80)]
    spans = spark.createDataFrame(rows, SPANS).coalesce(1)
    tree = {r.span_id: (r.depth, r.path) for r in traces.trace_tree(spans).collect()}
    assert tree == {f"{i:03d}": (i, "/".join(f"{k:03d}" for k in range(i + 1))) for i in range(80)}
    assert traces.trace_tree(spans, 2).count() == 3


def test_paths_cross_no_shuffle_and_are_not_written(spark):
    rows = [(i.to_bytes(16, "big"), f"t{i // 40}", f"{i % 40:03d}", f"{i % 40 - 1:03d}" if i % 40 else None, f"s{i}", "x", 100 + i, 200, "OK", [], i) for i in range(400)]
    written = len(paths._made)
    tree = traces.trace_tree(spark.createDataFrame(rows, SPANS).repartition(3))
    assert len(paths._made) == written and tree._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2  # the second is the test's
    assert {(r.trace_id, r.depth, r.path) for r in tree.collect()} == {(f"t{t}", i, "/".join(f"{k:03d}" for k in range(i + 1))) for t in range(10) for i in range(40)}


def test_small_and_large_traces_are_linked_alike(spark, monkeypatch):
    span = lambda t, s, p, seq=0, op="x": (seq.to_bytes(16, "big"), t, s, p, f"svc{seq}", op, 100 + seq, 200, "OK", [], seq)
    rows = [span("t", "a", None), span("t", "b", "a", 1), span("t", "c", "b", 2), span("t", "c", "a", 7), span("t", "d", "gone", 3), span("t", "e", "e", 4), span("t", "f", "g", 5), span("t", "g", "f", 6)]
    rows += [span("u", "a", "b", 8), span("u", "b", None, 9), span(None, "a", None, 10), span(None, "b", "a", 11), span("v", None, None, 12), span("v", "b", None, 13)]
    spans = spark.createDataFrame(rows, SPANS).repartition(3)
    want = {("t", "a"): (0, "a"), ("t", "b"): (1, "a/b"), ("t", "c"): (1, "a/c"), ("t", "d"): (0, "d"), ("u", "a"): (1, "b/a"), ("u", "b"): (0, "b"), (None, "a"): (0, "a"), (None, "b"): (0, "b"), ("v", None): (0, None), ("v", "b"): (0, "b")}
    edges = None
    for large, size in ((10**6, 10**7), (10**6, 1), (3, 10**7), (0, 10**7)):
        monkeypatch.setattr(traces, "LARGE_TRACE", large)
        monkeypatch.setattr(traces, "BATCH_BYTES", size)
        assert {(r.trace_id, r.span_id): (r.depth, r.path) for r in traces.trace_tree(spans).collect()} == want
        found = sorted((tuple(map(str, r)) for r in traces.trace_edges(spans).collect()))
        edges = edges or found
        assert found == edges and len(found) == 13
    up = {(r.trace_id, r.span_id): (r.parent_service, r.is_root, r.offset_ns) for r in traces.trace_edges(spans).collect()}
    assert up["t", "c"] == ("svc0", False, 7) and up["t", "f"] == ("svc6", False, 5) and up[None, "b"] == (None, True, 1) and up["u", "a"] == ("svc9", False, 0)


def test_a_trace_longer_than_arrow_batches(spark):
    kinds = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("parent_id", pa.string()), ("is_root", pa.bool_())])
    batch = lambda ids: pa.record_batch({"trace_id": [t for t, _ in ids], "span_id": [f"{i:02d}" for _, i in ids], "parent_id": [f"{i - 1:02d}" if i else None for _, i in ids], "is_root": [i == 0 for _, i in ids]}, schema=kinds)
    rows = [("a", i) for i in range(3)] + [("b", i) for i in range(20)] + [("c", 0)]
    for size in (1, 2, 3, 7, 24):
        got = [r for b in traces._with_paths(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert sorted((r["trace_id"], r["path"]) for r in got) == sorted((t, "/".join(f"{k:02d}" for k in range(i + 1))) for t, i in rows)


def test_scalars(spark):
    df = spark.createDataFrame([("warning", 3, 2.5), ("Error", 17, -2.5), ("", 0, float("nan")), (None, 22, 1e300)], "t string, n int, v double")
    got = df.select(scalars.parse_level(F.col("t")), scalars.severity_level(F.col("t"), F.col("n")), scalars.scaled_value(F.col("v"), 1), scalars.duration_bucket(F.col("n").cast("bigint"))).collect()
    assert [tuple(r) for r in got] == [("WARN", "WARN", 3, 1), ("INFO", "ERROR", -3, 4), ("INFO", "INFO", None, 0), ("INFO", "FATAL", None, 4)]
    ids = spark.range(3).select(scalars.new_entry_id(F.lit(1_700_000_000_123)).alias("i")).select(scalars.entry_id_ms(F.col("i")), F.length("i")).collect()
    assert {tuple(r) for r in ids} == {(1_700_000_000_123, 16)}
    key = spark.createDataFrame([({"b": 'q"', "a": "x"},)], "m map<string,string>").select(scalars.series_key(F.col("m")), scalars.group_key(F.col("m"), ["b", "zz"])).first()
    assert tuple(key) == ('"a"="x","b"="q\\""', '"b"="q\\"","zz"=""')
    assert spark.range(1).select(scalars.nanos_to_millis(F.lit(-1_999_999).cast("bigint"))).first()[0] == -1


def test_otlp_histograms_and_summaries(spark):
    point = {"timeUnixNano": "1717200000000000000", "attributes": [{"key": "route", "value": {"stringValue": "/api"}}], "count": "26", "sum": 1234.5, "min": 0.001, "max": 512, "scale": 4, "zeroCount": "3", "zeroThreshold": 1e-6, "positive": {"offset": -5, "bucketCounts": ["1", "0", "2"]}, "negative": {"offset": 2, "bucketCounts": ["1", "1"]}}
    explicit = {**{k: point[k] for k in ("timeUnixNano", "count", "sum")}, "bucketCounts": ["1", "25"], "explicitBounds": [5]}
    summary = {"timeUnixNano": "1717200000000000000", "quantileValues": [{"quantile": 0.5, "value": 2}, {"quantile": 0.9, "value": 7}]}
    metrics = [{"name": "d", "exponentialHistogram": {"aggregationTemporality": 2, "dataPoints": [point]}}, {"name": "e", "histogram": {"aggregationTemporality": 1, "dataPoints": [explicit]}}, {"name": "s", "summary": {"dataPoints": [summary]}}]
    request = {"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}]}, "scopeMetrics": [{"metrics": metrics}]}]}
    df = spark.createDataFrame([(json.dumps(request),)], "json string")
    h = otlp.exp_histograms(df).first()
    assert (h.ts_ms, h.scale, h.zero_count, list(h.pos), list(h.neg), h["sum"], h["count"], h.reject) == (1_717_200_000_000, 4, 3, [-5, [1, 0, 2]], [2, [1, 1]], 1234.5, 26, None)
    assert h.series_key == '"__name__"="d","resource.service.name"="x","route"="/api"'
    e = otlp.explicit_histograms(df).first()
    assert (e.bounds, e.counts, e.reject) == ([5.0], [1, 25], "histogram_temporality")
    assert sorted((r.labels["quantile"], r.value) for r in otlp.summary_samples(df).collect()) == [("0.5", 2000), ("0.9", 7000)]
    c = otlp.counts(otlp.explicit_histograms(df)).first()
    assert (c.accepted, c.rejected, c.unsupported) == (0, 0, 1)
    assert [tuple(r) for r in otlp.unsupported(df).collect()] == [("histogram_temporality", 1)]


def test_nothing_of_a_request_is_lost(spark):
    record = lambda n: {"timeUnixNano": str(n), "body": {"stringValue": "x"}}
    scopes = [{"logRecords": [record(1), record(2)]}, {}, {"logRecords": None}, {"logRecords": [record(3)]}]
    texts = [json.dumps({"resourceLogs": [{"scopeLogs": scopes}, {"resource": {}}]}), "not json", "", None, "{}", '{"resourceLogs": [{"scopeLogs": [']
    got = otlp.logs(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert sorted(r.ts_ns for r in got if r.reject is None) == [1, 2, 3] and sum(r.reject == "json" for r in got) == 4
    span = {"traceId": "ab" * 16, "spanId": "01" * 8}
    got = otlp.spans(spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{}, {"spans": [span]}]}]}),), ("[",)], "json string")).collect()
    assert sorted(str(r.reject) for r in got) == ["None", "json"]
    assert native.logs(spark.createDataFrame([("[",), ('[{"body": "b"}]',)], "json string").repartition(1)).selectExpr("sort_array(collect_list(coalesce(reject, '')))").first()[0] == ["", "json"]


def test_bad_numbers_are_rejected(spark):
    points = [{"count": "x", "bucketCounts": ["1"]}, {"count": "1", "bucketCounts": ["1", "y"]}, {"count": "-1"}, {"count": "2", "bucketCounts": ["2"]}]
    metrics = [{"name": "h", "histogram": {"aggregationTemporality": 2, "dataPoints": points}}, {"name": "e", "exponentialHistogram": {"aggregationTemporality": 2, "dataPoints": [{"count": "1", "zeroCount": "z"}, {"count": "1", "positive": {"bucketCounts": ["q"]}}]}}, {"name": "what"}]
    df = spark.createDataFrame([(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]}),)], "json string")
    assert [r.reject for r in otlp.explicit_histograms(df).collect()] == ["count"] * 3 + [None]
    assert [r.reject for r in otlp.exp_histograms(df).collect()] == ["count"] * 2
    assert [tuple(r) for r in otlp.unsupported(df).collect()] == [("unknown", 1)]


def _field(number, wire, data):
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | wire) + (varint(len(data)) + data if wire == 2 else varint(data) if wire == 0 else data)


def test_protobuf_requests(spark):
    text = lambda s: _field(1, 2, s.encode())
    pair = lambda k, v: _field(1, 2, k.encode()) + _field(2, 2, v)
    record = _field(1, 1, struct.pack("<Q", 1_700_000_000_000_000_001)) + _field(2, 0, 17) + _field(5, 2, text("boom é")) + _field(6, 2, pair("n", _field(3, 0, (1 << 64) - 5))) + _field(9, 2, bytes(range(1, 17))) + _field(99, 2, b"unknown")
    group = _field(1, 2, _field(1, 2, pair("service.name", text("shop")))) + _field(2, 2, _field(2, 2, record))
    bodies = [_field(1, 2, group), b"\xff\xff", None, b""]
    got = otlp.logs(otlp_protobuf.to_json(spark.createDataFrame([(b,) for b in bodies], "body binary"), "logs")).collect()
    good = [r for r in got if r.reject is None]
    assert len(good) == 1 and sum(r.reject == "json" for r in got) == 2
    assert (good[0].ts_ns, good[0].level, good[0].service, good[0].body, good[0].trace_id, good[0].attrs[0].value) == (1_700_000_000_000_000_001, "ERROR", "shop", "boom é", bytes(range(1, 17)).hex(), "-5")
    point = _field(3, 1, struct.pack("<Q", 5_000_000)) + _field(4, 1, struct.pack("<Q", 3)) + _field(5, 1, struct.pack("<d", 1.5)) + _field(6, 2, struct.pack("<QQ", 1, 2)) + _field(7, 2, struct.pack("<d", 9.0))
    exp = _field(3, 1, struct.pack("<Q", 5_000_000)) + _field(4, 1, struct.pack("<Q", 3)) + _field(6, 0, 3) + _field(8, 2, _field(1, 0, 5) + _field(2, 2, bytes([1, 2])))
    number = _field(3, 1, struct.pack("<Q", 5_000_000)) + _field(6, 1, struct.pack("<q", -7))
    metrics = [_field(1, 2, b"h") + _field(9, 2, _field(1, 2, point) + _field(2, 0, 2)), _field(1, 2, b"e") + _field(10, 2, _field(1, 2, exp) + _field(2, 0, 2)), _field(1, 2, b"g") + _field(5, 2, _field(1, 2, number))]
    body = _field(1, 2, _field(2, 2, b"".join(_field(2, 2, m) for m in metrics)))
    df = otlp_protobuf.to_json(spark.createDataFrame([(body,)], "body binary"), "metrics")
    h, e, g = otlp.explicit_histograms(df).first(), otlp.exp_histograms(df).first(), otlp.samples(df).first()
    assert (h.ts_ms, h.bounds, h.counts, h["sum"], h["count"], h.reject) == (5, [9.0], [1, 2], 1.5, 3, None)
    assert (e.scale, e.pos.offset, e.pos.counts, e.reject) == (-2, -3, [1, 2], None) and (g.value, g.reject) == (-7000, None)


def test_deep_chains_and_cycles(spark):
    rows = [(bytes([i]), "t", f"s{i}", f"s{i - 1}" if i else None, "a", "o", i, i + 1, "OK", i) for i in range(80)]
    rows += [(bytes([100 + i]), "u", f"s{i}", f"s{(i + 1) % 3}", "a", "o", i, i + 1, "OK", i) for i in range(3)]
    df = spark.createDataFrame(rows, "id binary, trace_id string, span_id string, parent_id string, service string, operation string, start_ns long, end_ns long, status string, ingest_seq long")
    got = {r.span_id: (r.depth, r.path) for r in traces.trace_tree(df).collect()}
    assert got == {f"s{i}": (i, "/".join(f"s{j}" for j in range(i + 1))) for i in range(80)}
    assert traces.trace_tree(df, 5).count() == 6 and traces.trace_tree(df.limit(0)).count() == 0


def test_spans_and_native_logs(spark):
    span = {"traceId": "AB" * 16, "spanId": "01" * 8, "name": "op", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "status": {"code": 2}}
    request = {"resourceSpans": [{"resource": {}, "scopeSpans": [{"spans": [span, {**span, "spanId": "xx"}]}]}]}
    got = otlp.spans(spark.createDataFrame([(json.dumps(request),)], "json string")).collect()
    assert [(r.trace_id, r.status, r.start_ns, r.end_ns, r.reject) for r in got] == [("ab" * 16, "ERROR", 5, 9, None), ("ab" * 16, "ERROR", 5, 9, "span_id")]
    entries = [{"level": "warn", "service": "s", "body": "b", "attrs": {"k": "v"}}, {"trace_id": "zz"}]
    got = native.logs(spark.createDataFrame([(json.dumps(entries),)], "json string")).collect()
    assert [(r.level, r.service, [tuple(a) for a in r.attrs], r.reject) for r in got] == [("WARN", "s", [("k", "v")], None), ("INFO", "", [], "trace_id")]


def test_limits(spark):
    rows = [("s", [("a", "1"), ("b", "1"), ("c", "1")]), ("s", [("a", "12345")]), ("s", [("a", "1")])]
    df = spark.createDataFrame(rows, "service string, attrs array<struct<key:string,value:string>>")
    assert [r.reject for r in df.select(ingest.Guard(2, 4).static_reject().alias("reject")).collect()] == ["attrs_per_entry", "attr_value_too_long", None]


def test_keys_are_limited_across_batches(spark, tmp_path):
    schema = "service string, attrs array<struct<key:string,value:string>>"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for keys in (["a", "b"], ["b"], ["c"], ["a", "a"]):
        spark.createDataFrame([("s", [(k, "1") for k in keys]), ("t", [(k, "1") for k in keys])], schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.guard_keys(spark.readStream.schema(schema).parquet(source), ingest.Guard(max_keys_per_service=2))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.service, tuple(a.key for a in r.attrs)): r.reject for r in spark.read.parquet(out).collect()}
    for s in "st":
        assert got[s, ("a", "b")] is None and got[s, ("b",)] is None and got[s, ("c",)] == "key_cardinality" and got[s, ("a", "a")] is None


def test_guarded_ingest(spark, tmp_path):
    """Keys and services are limited over all batches; a rejected record's keys don't count; a record without attributes passes."""
    schema = "service string, attrs array<struct<key:string,value:string>>, n int, reject string"
    source, out, bad = (str(tmp_path / n) for n in ("in", "out", "bad"))
    batches = [[("s", ["a", "b"], 1), ("t", ["x"], 2), ("u", ["y"], 3)], [("s", ["c"], 4), ("s", ["b", "a"], 5), ("t", ["y", "z"], 6), ("t", ["y"], 7)], [("t", [], 8), ("t", ["z"], 9), ("s", ["a"] * 3, 10)]]
    for rows in batches:
        spark.createDataFrame([(s, [(k, "1") for k in keys], n, None) for s, keys, n in rows], schema).coalesce(1).write.mode("append").parquet(source)
        guard = ingest.Guard(max_attrs=2, max_keys_per_service=2, max_services=2)
        ingest.start_ingest(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state"), bad, guard).awaitTermination()
    got = {r.n: None for r in spark.read.parquet(out).collect()} | {r.n: r.reject for r in spark.read.parquet(bad).collect()}
    assert got == {1: None, 2: None, 3: "service_cardinality", 4: "key_cardinality", 5: None, 6: "key_cardinality", 7: None, 8: None, 9: "key_cardinality", 10: "attrs_per_entry"}


def test_ingest_writes_each_batch_once(spark, tmp_path):
    request = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "7", "body": {"stringValue": "x"}}, {"traceId": "bad"}]}]}]}
    source = tmp_path / "requests"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(request))
    args = str(tmp_path / "logs"), str(tmp_path / "state"), str(tmp_path / "rejects")
    for _ in range(2):
        ingest.start_ingest(otlp.logs(ingest.requests(spark, str(source))), *args).awaitTermination()
    assert spark.read.parquet(args[0]).count() == 1 and spark.read.parquet(args[2]).first().reject == "trace_id"


def test_journal(spark, tmp_path):
    logs = native.generated_logs(spark, 20, 1000, 2000)
    path = str(tmp_path / "journal")
    journal.append(journal.normalised(logs, "logs", "ts_ns"), path)
    back = journal.replay(spark, path, "logs").collect()
    assert [r.ingest_seq for r in back] == list(range(20)) and json.loads(back[3].payload)["service"] == logs.collect()[3].service
    assert journal.subset(logs, logs.limit(5), "ingest_seq").count() == 5 and journal.subset(logs, logs.limit(5), "ingest_seq", True).count() == 15


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_an_attribute_without_a_key_costs_no_other(spark):
    pair = lambda v, **k: {**k, "value": {"stringValue": v}}
    attributes = [pair("old", key="service.name"), pair("shop", key="service.name"), pair("x")]
    request = {"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"spans": [{"traceId": "AB" * 16, "spanId": "01" * 8}]}]}]}
    found = otlp.spans(spark.createDataFrame([(json.dumps(request),)], "json string")).select("trace_id", "service", "reject")
    assert tuple(found.first()) == ("ab" * 16, "shop", None)
