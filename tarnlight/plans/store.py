"""One object with all queries over a set of tables, and request parameters turned into queries."""

from __future__ import annotations

import io
import time
from collections.abc import Mapping, Sequence
from contextlib import redirect_stdout
from dataclasses import dataclass
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import times
from tarnlight.functions.scalars import utc_seconds
from tarnlight.functions.tokens import stemmed_tokens
from tarnlight.operators import catalog, histograms, maintenance, metrics, search, traces
from tarnlight.operators.selectors import Selector, metric

MAX_PAGE, DEFAULT_TRACES, MAX_OFFSET = 1000, 20, 1_000_000


class ParameterError(ValueError):
    """A request parameter that can't be used; its name comes first."""


class Parameters:
    """Query parameters of a request; of a repeated one the first counts, but for those asked for with all()."""

    def __init__(self, given: str | Mapping[str, Sequence[str] | str]):
        found = parse_qs(given, keep_blank_values=True) if isinstance(given, str) else given
        self.values = {k: [v] if isinstance(v, str) else list(v) for k, v in found.items()}

    def text(self, name: str) -> str:
        return (self.values.get(name) or [""])[0]

    def all(self, name: str) -> list[str]:
        return self.values.get(name, [])

    def names(self, name: str) -> list[str]:
        return [x.strip() for x in self.text(name).split(",") if x.strip()]

    def number(self, name: str, default: int, low: int, high: int) -> int:
        raw = self.text(name)
        if not raw:
            return default
        try:
            n = int(raw)
        except ValueError as e:
            raise ParameterError(f"{name}: not a whole number") from e
        if not low <= n <= high:
            raise ParameterError(f"{name}: not between {low} and {high}")
        return n

    def parsed(self, name: str, f, default=None):
        raw = self.text(name).strip()
        if not raw:
            return default
        try:
            return f(raw)
        except ValueError as e:
            raise ParameterError(f"{name}: {e}") from e

    def needed(self, name: str, f=str):
        out = self.parsed(name, f)
        if out is None:
            raise ParameterError(f"{name}: missing")
        return out


def log_query(p: Parameters) -> search.LogQuery:
    """service, level, host (lists by comma), q, from, to (RFC 3339), limit 1 to 1000, cursor, attr.NAME."""
    attrs = {k[5:]: v[0] for k, v in p.values.items() if k.startswith("attr.") and len(k) > 5}
    return search.LogQuery(
        start_ns=p.parsed("from", times.rfc3339_ns), end_ns=p.parsed("to", times.rfc3339_ns), services=p.names("service"), attrs=attrs, limit=p.number("limit", 0, 1, MAX_PAGE), cursor=p.text("cursor") or None,
        levels=p.names("level"), hosts=p.names("host"), text=p.text("q") or None,
    ).validate()


def trace_query(p: Parameters) -> tuple[search.SpanQuery, int, int]:
    """service, operation (lists by comma), min_duration, max_duration, from, to; with the page's limit (20) and offset."""
    limit, offset = p.number("limit", DEFAULT_TRACES, 1, MAX_PAGE), p.number("offset", 0, 0, MAX_OFFSET)
    if offset > MAX_OFFSET - limit:
        raise ParameterError("offset: too large with this limit")
    query = search.SpanQuery(
        start_ns=p.parsed("from", times.rfc3339_ns), end_ns=p.parsed("to", times.rfc3339_ns), services=p.names("service"), operations=p.names("operation"),
        min_duration_ns=p.parsed("min_duration", times.duration_ns, 0), max_duration_ns=p.parsed("max_duration", times.duration_ns, 0),
    )
    return query, limit, offset


def metric_selector(p: Parameters) -> Selector:
    """metric and any number of selector=label=value."""
    return Selector((metric(p.needed("metric")), *Selector.of_pairs(p.all("selector")).matchers))


def _ms(text: str) -> int:
    return times.duration_ns(text) // 1_000_000


@dataclass
class Store:
    """Tables of logs, spans, samples and histograms, and what can be asked of them. Results are DataFrames."""

    logs: DataFrame
    spans: DataFrame
    samples: DataFrame
    exp: DataFrame
    explicit: DataFrame

    def search_logs(self, query: search.LogQuery) -> DataFrame:
        return search.search_logs(self.logs, query)

    def search_spans(self, query: search.SpanQuery) -> DataFrame:
        return search.search_spans(self.spans, query)

    def query_logs(self, parameters: str | Mapping) -> search.Page:
        return search.fetch_page(self.logs, log_query(Parameters(parameters)))

    def query_traces(self, parameters: str | Mapping) -> DataFrame:
        query, limit, offset = trace_query(Parameters(parameters))
        return traces.trace_summaries(self.spans, query, limit, offset)

    def count_traces(self, parameters: str | Mapping) -> DataFrame:
        """(total) of all pages of query_traces()."""
        return traces.trace_total(self.spans, trace_query(Parameters(parameters))[0])

    def trace_with_logs(self, trace_id: str) -> DataFrame:
        """The spans of a trace, each with its parent, its offset and its logs."""
        return traces.logs_of_spans(search.matching(self.spans, search.SpanQuery(trace_id=trace_id)), search.matching(self.logs, search.LogQuery(trace_id=trace_id)))

    def trace(self, trace_id: str) -> tuple[DataFrame, DataFrame]:
        return traces.lookup_trace(self.spans, self.logs, trace_id)

    def trace_tree(self, trace_id: str) -> DataFrame:
        return traces.trace_tree(search.matching(self.spans, search.SpanQuery(trace_id=trace_id)))

    def services(self) -> DataFrame:
        return catalog.services(self.logs, self.spans)

    def metric_names(self) -> DataFrame:
        return catalog.metric_names(self.samples)

    def histogram_metric_names(self) -> DataFrame:
        return catalog.metric_names(self.exp.select("labels").union(self.explicit.select("labels")))

    def metric_rate(self, parameters: str | Mapping) -> DataFrame:
        """metric, window, end (RFC 3339 or ms), by, selector: (grp, value)."""
        p = Parameters(parameters)
        options = metrics.window_options(p.needed("end", times.end_ms), p.needed("window", _ms))
        return metrics.rate_by_label(self.samples, metric_selector(p), p.text("by").strip(), options)

    def metric_rate_range(self, parameters: str | Mapping) -> DataFrame:
        """metric, window, step, from, to, by, selector: (step_ms, grp, value), a row of nulls for steps without values."""
        p = Parameters(parameters)
        steps = metrics.Steps(p.needed("from", times.end_ms), p.needed("to", times.end_ms), p.needed("step", _ms), p.needed("window", _ms))
        return metrics.rate_steps(self.samples, metric_selector(p), p.text("by").strip(), steps, with_empty=True)

    def metric_quantile(self, parameters: str | Mapping) -> DataFrame:
        """metric, q from 0 to 1, window and end or neither, by, selector: (grp, value) of exponential histograms."""
        p = Parameters(parameters)
        q = p.needed("q", float)
        if not 0 <= q <= 1:
            raise ParameterError("q: not between 0 and 1")
        end, window = p.parsed("end", times.end_ms), p.parsed("window", _ms)
        start = end - window if end is not None and window is not None else None
        return histograms.exp_quantile(histograms.within(self.exp, metric_selector(p), start, end), q, p.text("by").strip())

    def select(self, selector: str, options: metrics.Options = metrics.Options()) -> DataFrame:
        return metrics.select(self.samples, Selector.parse(selector), options)

    def explicit_quantile(self, selector: str, q: float, by: str = "") -> DataFrame:
        return histograms.explicit_quantile(histograms.within(self.explicit, Selector.parse(selector)), q, by)

    def histogram_summary(self, selector: str, by: str = "") -> DataFrame:
        chosen = Selector.parse(selector)
        return histograms.summary_of_both(chosen.apply(self.exp), chosen.apply(self.explicit), by)

    def metric_stats(self) -> DataFrame:
        return catalog.metric_stats(self.samples)

    def log_stats(self) -> DataFrame:
        return catalog.log_stats(self.logs)


@dataclass(frozen=True)
class StoredTables:
    """Tables of a store below one folder: logs and spans by day, samples and histograms by metric name."""

    path: str

    KINDS = {"logs": "ts_ns", "spans": "start_ns", "samples": None, "exp": None, "explicit": None}

    def append(self, kind: str, rows: DataFrame) -> None:
        """Adds rows to a table; searches of a store opened afterwards see them."""
        ts = self.KINDS[kind]
        if ts is not None:
            maintenance.write_segments(rows, f"{self.path}/{kind}", ts)
        else:
            keys = ("metric_name", "series_key", "ts_ms")
            maintenance.named(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy("metric_name").parquet(f"{self.path}/{kind}")

    def open(self, spark: SparkSession, **head: DataFrame) -> Store:
        """A store over the tables, each with the rows of head under its name, which aren't stored yet."""
        found = {}
        for kind in self.KINDS:
            stored = spark.read.parquet(f"{self.path}/{kind}")
            found[kind] = with_head(stored, head[kind]) if kind in head else stored
        return Store(**found)


def with_head(stored: DataFrame, head: DataFrame) -> DataFrame:
    """Stored rows and those not stored yet as one table; columns that only stored rows have are null for the others, but for those that storing makes."""
    if "metric_name" in stored.columns and "metric_name" not in head.columns:
        head = maintenance.named(head)
    if "tokens" in stored.columns and "tokens" not in head.columns:
        head = head.withColumn("tokens", stemmed_tokens(F.col("body")))
    if "day" in stored.columns and "day" not in head.columns:
        head = head.withColumn("day", F.to_date(utc_seconds(F.col("ts_ns" if "ts_ns" in head.columns else "start_ns"))))
    return stored.unionByName(head, allowMissingColumns=True)


def cost(result: DataFrame) -> dict[str, int]:
    """What the optimiser expects of a result before it runs: bytes, operators, shuffles and scans of its plan."""
    execution = result._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    return {"bytes": int(str(execution.optimizedPlan().stats().sizeInBytes())), "operators": plan.count("\n"), "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"), "scans": plan.count("FileScan")}


def execute(result: DataFrame) -> tuple[list[Row], dict[str, int]]:
    """The rows of a result, its cost() and what running it took, in ms."""
    expected, began = cost(result), time.perf_counter()
    rows = result.collect()
    return rows, expected | {"rows": len(rows), "ms": int((time.perf_counter() - began) * 1000)}


def explain(result: DataFrame) -> str:
    """The formatted plan of a result."""
    out = io.StringIO()
    with redirect_stdout(out):
        result.explain("formatted")
    return out.getvalue()
