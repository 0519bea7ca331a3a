import math
import random

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import scalars
from tarnlight.operators import histograms, maintenance, metrics
from tarnlight.operators.metrics import Options, Steps
from tarnlight.operators.selectors import Matcher, Selector, SelectorError
from tarnlight.schema import EXPLICIT_HISTOGRAMS, SAMPLES
from tarnlight.sources.tables import exp_from_values, explicit_from_values

ALL = Selector(())


def samples(spark, series, kind="counter"):
    rows, seq = [], 0
    for labels, points in series:
        key = ",".join(f'"{k}"="{v}"' for k, v in sorted(labels.items()))
        for ts, value in points:
            rows.append((key, labels, kind, ts, value, seq))
            seq += 1
    return spark.createDataFrame(rows, SAMPLES)


def rates(df, **kw):
    return {r.grp: r.value for r in metrics.rate_by_label(df, ALL, "job", Options(**kw)).collect()}


def test_rate_literals(spark):
    one = lambda *p: samples(spark, [({"job": "a"}, p)])
    assert rates(one((0, 10), (1000, 20), (2000, 30))) == {"a": 10.0}
    assert rates(one((0, 100), (1000, 150), (2000, 10), (3000, 30)))["a"] == pytest.approx(70 / 3)
    summary = metrics.rate_summaries(one((0, 100), (1000, 120), (2000, 10), (3000, 80)), ALL).first()
    assert (summary.increase, summary.resets, summary.samples) == (90, 1, 4)
    assert rates(one((0, 1), (1000, 2), (5000, 3)), max_gap_ms=2000) == {}
    assert metrics.increase_by_label(one((0, 1), (1000, 2), (2000, 3)), ALL, "job", Options(max_gap_ms=2000)).first().value == 2
    assert rates(one((5, 1))) == {} and rates(one((5, 1), (5, 9))) == {}


def test_closed_window(spark):
    df = samples(spark, [({"job": "api", "i": "A"}, [(t, 1) for t in range(1000, 64_001, 1000)]), ({"job": "api", "i": "B"}, [(t, 2) for t in range(0, 63_001, 1000)])], "gauge")
    r = metrics.aggregate_steps(df, ALL, "job", Steps(64_000, 64_000, 1000, 63_000)).first()
    assert (r.sum, r["count"], r.min, r.max) == (190, 127, 1, 2)


def naive(series, steps, gap, kind):
    out = {}
    for labels, points in series:
        last = {}
        for ts, value in points:
            last[ts] = value
        for k in range(steps.last + 1):
            t = steps.start_ms + k * steps.step_ms
            w = [(x, last[x]) for x in sorted(last) if t - steps.window_ms <= x <= t]
            if gap and any(b[0] - a[0] > gap for a, b in zip(w, w[1:])):
                continue
            if kind == "aggregate":
                if w:
                    g = out.setdefault((t, labels["job"]), [0, 0, math.inf, -math.inf])
                    v = [x[1] for x in w]
                    out[t, labels["job"]] = [g[0] + sum(v), g[1] + len(v), min(g[2], *v), max(g[3], *v)]
            elif len(w) >= 2:
                inc = sum(max(b[1] - a[1], 0) for a, b in zip(w, w[1:]))
                out[t, labels["job"]] = out.get((t, labels["job"]), 0) + (inc if kind == "increase" else inc / ((w[-1][0] - w[0][0]) / 1000))
    return out


@pytest.mark.parametrize("seed, gap", [(1, None), (2, 9000), (3, None)])
def test_steps_against_a_fold(spark, seed, gap):
    rng = random.Random(seed)
    series = []
    for i in range(12):
        ts, value, points = rng.randrange(5000), 0, []
        for _ in range(40):
            ts += rng.choice([0, 1000, 5000, 10_000])
            value = 0 if rng.random() < 0.1 else value + rng.randrange(100)
            points.append((ts, value))
        series.append(({"job": f"j{i % 3}", "i": str(i)}, points))
    df = samples(spark, series).repartition(5)
    for window in (15_000, 30_000):
        steps = Steps(10_000, 130_000, 15_000, window)
        opt = Options(max_gap_ms=gap)
        got = {(r.step_ms, r.grp): r.value for r in metrics.rate_steps(df, ALL, "job", steps, opt).collect()}
        assert got == pytest.approx(naive(series, steps, gap, "rate"), rel=1e-9)
        assert {(r.step_ms, r.grp): r.value for r in metrics.increase_steps(df, ALL, "job", steps, opt).collect()} == naive(series, steps, gap, "increase")
        assert {(r.step_ms, r.grp): [r.sum, r["count"], r.min, r.max] for r in metrics.aggregate_steps(df, ALL, "job", steps, opt).collect()} == naive(series, steps, gap, "aggregate")


def test_grid(spark):
    df = samples(spark, [({"job": "a"}, [(0, 1), (10, 2)])])
    got = metrics.rate_steps(df, ALL, "job", Steps(0, 25, 10, 10), with_empty=True).orderBy("step_ms").collect()
    assert [(r.step_ms, r.grp) for r in got] == [(0, None), (10, "a"), (20, None)]  # the end is no step of its own
    for bad in (Steps(0, 1, 0, 1), Steps(1, 0, 1, 1), Steps(0, 10_000, 1, 1), Steps(0, 1, 1, 0)):
        with pytest.raises(ValueError):
            bad.validate()


def test_selectors(spark):
    s = Selector.parse('http{route=~"^/a", code!="500",x!~"q\\"z"}[5m]')
    assert s.window_ms == 300_000 and [m.op for m in s.matchers] == ["=", "=~", "!=", "!~"] and s.matchers[3].value == 'q"z'
    for bad in ("", "{}", 'x{a="b"', 'x{a~"b"}', "x[5y]", 'x{a=~"("}'):
        with pytest.raises(SelectorError):
            Selector.parse(bad)
    df = spark.createDataFrame([({"a": "xby"},), ({"a": "b"},), ({"c": "d"},)], "labels map<string,string>")
    hits = lambda op, v: [x[0] for x in df.select(Matcher("a", op, v).column()).collect()]
    assert (hits("=", "b"), hits("!=", "b"), hits("=~", "b"), hits("!~", "^b")) == ([False, True, False], [True, False, True], [True, True, False], [True, False, True])
    assert Selector.of_pairs(["a=b=c"]).matchers[0].value == "b=c"


def test_explicit_histograms(spark):
    def ticks(*values, bounds=(10.0, 20.0, 30.0)):
        rows = spark.createDataFrame([("s", {"a": "x"}, 1, float(v)) for v in values], "series_key string, labels map<string,string>, ts_ms long, value double")
        return explicit_from_values(rows, list(bounds))

    both = ticks(5, 15, 25).union(ticks(15, 35, 45))
    assert [r.n for r in histograms.explicit_merge(both).orderBy("i").collect()] == [1, 2, 1, 2]
    s = histograms.summary(both).first()
    assert (s["count"], s.sum) == (6, 140.0)
    with pytest.raises(Exception, match="different bounds"):
        histograms.explicit_merge(ticks(1).union(ticks(1, bounds=(10.0, 21.0, 30.0)))).collect()
    assert histograms.explicit_quantile(spark.createDataFrame([], EXPLICIT_HISTOGRAMS), 0.5).count() == 0
    many = ticks(*[i * 0.064 for i in range(1, 1001)], bounds=[float(2**i) for i in range(7)])
    for q in (0.1, 0.5, 0.9):
        assert 0.5 <= histograms.explicit_quantile(many, q).first().value / (q * 64) <= 1.6


def test_exponential_histograms(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 2) for _ in range(4000)]
    rows = spark.createDataFrame([("s", {"a": "x"}, i % 2, v) for i, v in enumerate(values)], "series_key string, labels map<string,string>, ts_ms long, value double")
    mixed = exp_from_values(rows.filter("ts_ms = 0"), 5).union(exp_from_values(rows.filter("ts_ms = 1"), 3))
    merged = histograms.exp_merge(mixed).first()
    assert merged.scale == 3 and merged["count"] == 4000 and sum(merged.pos.values()) == 4000
    values.sort()
    for q in (0.01, 0.5, 0.95, 0.99):
        got, true = histograms.exp_quantile(mixed, q).first().value, values[int(q * 4000) - 1]
        assert abs(got / true - 1) <= 1.5 * scalars.gamma(3)
    signs = spark.createDataFrame([("s", {}, 1, v) for v in (-8.5, -2.5, 0.0, 0.0, 3.0, float("nan"))], rows.schema)
    h = exp_from_values(signs, 2, 0.5)
    assert h.first().zero_count == 2 and h.first()["count"] == 5
    assert [round(histograms.exp_quantile(h, q).first().value, 1) for q in (0, 0.3, 0.5, 1)] == [-8.7, -2.6, 0.0, 3.1]


def test_bucket_edges(spark):
    powers = spark.createDataFrame([(k, float(2.0**k)) for k in range(-40, 63)], "k int, v double")
    assert powers.filter(scalars.exp_bucket(F.col("v"), 3) != F.col("k") * 8 - 1).count() == 0
    assert scalars.duration_buckets(7, 9) == [2, 3] and scalars.duration_buckets() == list(range(64))


def test_maintenance(spark):
    df = samples(spark, [({"job": "a"}, [(1, 5), (1, 7), (2, 1), (2, 1)])])
    assert sorted((r.ts_ms, r.value) for r in maintenance.compact_samples(df).collect()) == [(1, 7), (2, 1)]
    assert maintenance.compact_samples(df, 2).count() == 1
    day = 86_400 * 10**9
    segs = spark.createDataFrame([(s, s * day, 100, s == 4) for s in range(1, 11)], "segment_id long, max_ts long, size_bytes long, delete_pending boolean")
    chosen = lambda **p: {r.segment_id: r.reason for r in maintenance.select_for_deletion(segs, maintenance.Retention(**p), 11 * day).collect()}
    assert chosen() == {4: "delete_pending"}
    assert chosen(max_age_ns=8 * day) == {4: "delete_pending", 1: "max_age", 2: "max_age"}
    assert chosen(max_segments=7) == {4: "delete_pending", 1: "max_segments", 2: "max_segments"}
    assert chosen(max_bytes=500) == {4: "delete_pending", **{s: "max_total_bytes" for s in (1, 2, 3, 5)}}
    assert maintenance.fingerprint(df).first() == maintenance.fingerprint(df.repartition(3)).first()
    assert maintenance.fingerprint(df).first() != maintenance.fingerprint(df.limit(3)).first()
    assert {r.series_key for r in maintenance.cold_series(df, 100, 98).collect()} == {'"job"="a"'} and maintenance.cold_series(df, 100, 99).count() == 0


def test_step_windows_are_not_computed_anew_for_each_sample(spark):
    rows = [('"__name__"="m"', {"__name__": "m"}, "gauge", i * 7 % 1000, (i * 37) % 101, i) for i in range(200)]
    samples = spark.createDataFrame(rows, "series_key string, labels map<string,string>, type string, ts_ms bigint, value bigint, ingest_seq bigint")
    steps = metrics.Steps(0, 1000, 50, 130)
    for gap in (None, 15):
        out = metrics.aggregate_steps(samples, Selector.parse("m"), "", steps, metrics.Options(max_gap_ms=gap))
        assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString()
        kept = {r[3]: r[4] for r in rows}
        want = {}
        for t in range(0, 1001, 50):
            times = sorted(x for x in kept if t - 130 <= x <= t)
            if times and (gap is None or all(b - a <= gap for a, b in zip(times, times[1:]))):
                want[t] = (sum(kept[x] for x in times), len(times), min(kept[x] for x in times), max(kept[x] for x in times))
        assert {r.step_ms: (r["sum"], r["count"], r["min"], r["max"]) for r in out.collect()} == want
