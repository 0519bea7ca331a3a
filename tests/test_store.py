from datetime import timedelta, timezone

import pytest

from tarnlight.functions import times
from tarnlight.operators import maintenance, metrics, search, selectors, traces
from tarnlight.plans import store
from tarnlight.sources import paths, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    samples = tables.gauges(spark, SF).unionByName(tables.counters(spark, SF))
    return store.Store(tables.logs(spark, SF), tables.spans(spark, SF), samples, tables.exp_histograms(spark, SF), tables.explicit_histograms(spark, SF))


def test_times():
    assert [times.duration_ns(t) for t in ("1h30m", "250ms", "-1.5s", "0", "1us")] == [5_400 * 10**9, 250 * 10**6, -1_500_000_000, 0, 1000]
    assert times.since_ns("2d") == 2 * 86_400 * 10**9 and times.since_ns("1w") == 7 * 86_400 * 10**9 and times.since_ns("15m") == 900 * 10**9
    assert times.rfc3339_ns("1970-01-01T01:00:00.000000007+01:00") == 7
    assert times.time_ns("1970-01-02", timezone(timedelta(hours=1))) == 23 * 3600 * 10**9 and times.time_ns("1970-01-01 00:01") == 60 * 10**9
    assert times.end_ms("12") == 12 and times.end_ms("1970-01-01T00:00:01Z") == 1000
    assert times.resolve_range("1m", "", "1970-01-02", 100 * 10**9) == (40 * 10**9, 86_400 * 10**9) and times.resolve_range() == (None, None)
    for f, bad in ((times.duration_ns, "5"), (times.duration_ns, ""), (times.since_ns, "xd"), (times.rfc3339_ns, "2024-01-01"), (times.time_ns, "soon"), (times.end_ms, "1.5")):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(ValueError):
        times.resolve_range("1m", "1970-01-01", "")


def test_parameters():
    q = store.log_query(store.Parameters("service=a,%20b&level=ERROR&q=x+y&limit=7&attr.k=v&from=1970-01-01T00:00:00Z&attr.=z"))
    assert (q.services, q.levels, q.text, q.limit, dict(q.attrs), q.start_ns) == (["a", "b"], ["ERROR"], "x y", 7, {"k": "v"}, 0)
    assert store.log_query(store.Parameters("")).limit == 100
    query, limit, offset = store.trace_query(store.Parameters({"operation": "a,b", "min_duration": "3ms", "offset": "5"}))
    assert (query.operations, query.min_duration_ns, limit, offset) == (["a", "b"], 3_000_000, 20, 5)
    for f, bad in ((store.log_query, "limit=0"), (store.log_query, "limit=1001"), (store.log_query, "from=now"), (store.trace_query, "offset=999999&limit=20"), (store.trace_query, "min_duration=3"), (store.metric_selector, "selector=a=b"), (store.metric_selector, "metric=m&selector=ab")):
        with pytest.raises(ValueError):
            f(store.Parameters(bad))
    with pytest.raises(search.QueryError):
        store.log_query(store.Parameters("cursor=zz"))


def test_requests(stored):
    page = stored.query_logs("level=ERROR&limit=5")
    assert len(page.rows) == 5 and stored.query_logs({"level": "ERROR", "limit": "5", "cursor": page.next_cursor}).rows[0].ts_ns < page.rows[0].ts_ns
    top = stored.query_traces("limit=3").collect()
    assert [r.start_ns for r in top] == sorted((r.start_ns for r in top), reverse=True)
    assert stored.trace_tree(top[0].trace_id).count() >= 1 and stored.trace(top[0].trace_id)[0].count() >= 1
    assert stored.services().count() == 6 and [r.name for r in stored.metric_names().collect()] == ["event_total", "event_value"]
    assert [r.name for r in stored.histogram_metric_names().collect()] == ["event_duration", "event_size"]
    rate = "metric=event_total&window=240h&end=2024-01-20T00:00:00Z&by=event_type"
    assert 0 < stored.metric_rate(rate + "&selector=event_type=click").count() <= stored.metric_rate(rate).count() == 5
    steps = stored.metric_rate_range("metric=event_total&window=48h&step=24h&from=2024-01-10T00:00:00Z&to=2024-01-12T12:00:00Z")
    assert sorted(r.step_ms for r in steps.collect()) == [1704844800000 + i * 86_400_000 for i in range(3)]
    assert stored.metric_quantile("metric=event_duration&q=0.5&by=event_type").count() == 5
    with pytest.raises(store.ParameterError):
        stored.metric_quantile("metric=event_duration&q=2")
    with pytest.raises(store.ParameterError):
        stored.metric_rate("metric=event_total&end=0")
    assert stored.explicit_quantile("event_size", 0.5).count() == 1 and stored.histogram_summary("event_size").first()["count"] == 1000
    assert stored.select('event_value{event_type="click"}').count() > 0 and stored.metric_stats().count() == 2 and stored.log_stats().count() > 5
    assert "TakeOrderedAndProject" in store.explain(stored.search_logs(search.LogQuery(limit=3)))
    assert stored.search_spans(search.SpanQuery(limit=2)).count() == 2
    assert stored.count_traces("service=svc-1").first().total > 0 and stored.trace_with_logs(top[0].trace_id).count() == top[0].span_count
    rows, spent = store.execute(stored.services())
    assert len(rows) == 6 and spent["rows"] == 6 and spent["scans"] == 2 and spent["shuffles"] >= 1 and spent["bytes"] > 0


def plan(df):
    return store.explain(df)


def test_stored_tables_prune(spark, tmp_path):
    tables_ = store.StoredTables(str(tmp_path))
    logs, samples = tables.logs(spark, SF), tables.gauges(spark, SF).unionByName(tables.counters(spark, SF))
    for kind, rows in (("logs", logs), ("spans", tables.spans(spark, SF).limit(20)), ("samples", samples), ("exp", tables.exp_histograms(spark, SF)), ("explicit", tables.explicit_histograms(spark, SF))):
        tables_.append(kind, rows)
    found = tables_.open(spark)
    day = 1_704_844_800_000_000_000
    query = search.LogQuery(start_ns=day, end_ns=day + 86_400_000_000_000 - 1, text="viewing")
    chosen = search.matching(found.logs, query)
    assert "day" in plan(chosen).split("PartitionFilters")[1].split("\n")[0] and "MapInArrow" not in plan(chosen) and "ArrowEvalPython" not in plan(chosen)
    key = lambda r: r.ingest_seq
    assert sorted(map(key, chosen.collect())) == sorted(map(key, search.matching(logs, query).collect())) != []
    maintenance.write_series(samples, str(tmp_path / "series"))
    picked = metrics.select_stored(found.samples, spark.read.parquet(str(tmp_path / "series")), selectors.Selector.parse('event_value{event_type="click"}'), metrics.Options(start_ms=day // 1_000_000))
    assert plan(picked).count("= event_value") >= 2 and "PushedFilters: [IsNotNull(ts_ms), GreaterThanOrEqual(ts_ms" in plan(picked)
    want = metrics.select(samples, selectors.Selector.parse('event_value{event_type="click"}'), metrics.Options(start_ms=day // 1_000_000))
    assert sorted((r.series_key, r.ts_ms, r.value) for r in picked.collect()) == sorted((r.series_key, r.ts_ms, r.value) for r in want.collect())
    again = tables_.open(spark, logs=logs.limit(3))
    assert again.logs.count() == logs.count() + 3 and again.logs.filter("tokens IS NULL OR day IS NULL").count() == 0


def test_a_day_is_several_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS ts_ns", "lpad(hex(id), 32, '0') AS trace_id", "'it was authorized' AS body")
    maintenance.write_segments(rows, str(tmp_path / "logs"), max_records=1500)
    back = spark.read.parquet(str(tmp_path / "logs"))
    assert back.count() == 4000 and back.select("_metadata.file_path").distinct().count() >= 3


def test_stems(spark):
    bodies = ["payment timeout", "payment authorized", "authors wait", "Zahlung über", "no"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    find = lambda text: [r.body for r in search.matching(rows, search.LogQuery(text=text)).collect()]
    assert find("author") == bodies[1:3] and find("authorizing PAYMENTS") == bodies[1:2] and find("über") == bodies[3:4] and find("no") == bodies[4:] and find("?!") == []
    assert [r.body for r in search.matching(rows, search.LogQuery(exact_text="author")).collect()] == []


def test_copies_are_told_apart(spark, tmp_path):
    two = [spark.createDataFrame([(x,) for x in rows], "v string") for rows in (["a", "a", "b"], ["c", "c", "b"])]
    assert maintenance.fingerprint(two[0]).first() != maintenance.fingerprint(two[1]).first()
    assert maintenance.drill(two[0], str(tmp_path / "drill"))


def test_plans_sort_no_aggregates(spark):
    spans = tables.spans(spark, SF)
    for df in (traces.trace_summaries(spans), traces.trace_edges(spans), maintenance.compact_samples(tables.gauges(spark, SF))):
        assert "SortAggregate" not in plan(df)


def test_maintenance_round(spark, tmp_path):
    samples = tables.gauges(spark, SF)
    cold = maintenance.maintain_samples(samples, str(tmp_path), 1_706_659_200_000, 10 * 86_400_000)
    stored = spark.read.parquet(str(tmp_path / "samples"))
    assert stored.agg({"ts_ms": "min"}).first()[0] >= 1_706_659_200_000 - 10 * 86_400_000 and cold.count() == 0
    assert spark.read.parquet(str(tmp_path / "series")).agg({"samples": "sum"}).first()[0] == stored.count()


def test_written_tables_are_cleared(spark):
    path = paths.new_path(spark, "table")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and paths.clear(spark) >= 1 and paths.clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
