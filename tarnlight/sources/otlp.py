"""OTLP requests as JSON: records of logs, spans and metrics, with rejects beside them; works on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.scalars import hex_id, last_entries, nanos_to_millis, new_entry_id, otlp_labels, quantile_labels, scaled_value, series_key, severity_level, span_status

ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>"
KV = f"array<struct<key:string,value:{ANY}>>"
RESOURCE = f"resource:struct<attributes:{KV}>"
LOGS = f"resourceLogs array<struct<{RESOURCE},scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityText:string,severityNumber:int,body:{ANY},attributes:{KV},traceId:string,spanId:string>>>>>>"
SPANS = f"resourceSpans array<struct<{RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:{KV}>>>>>>"
_NUMBER = f"array<struct<timeUnixNano:string,asInt:string,asDouble:double,attributes:{KV}>>"
_HISTOGRAM = f"array<struct<timeUnixNano:string,attributes:{KV},count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>>>"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
_EXP = f"array<struct<timeUnixNano:string,attributes:{KV},count:string,sum:double,min:double,max:double,scale:int,zeroCount:string,zeroThreshold:double,positive:{_SIDE},negative:{_SIDE}>>"
_SUMMARY = f"array<struct<timeUnixNano:string,attributes:{KV},quantileValues:array<struct<quantile:double,value:double>>>>"
METRICS = (
    f"resourceMetrics array<struct<{RESOURCE},scopeMetrics:array<struct<scope:struct<attributes:{KV}>,metrics:array<struct<name:string,gauge:struct<dataPoints:{_NUMBER}>,"
    f"sum:struct<aggregationTemporality:string,isMonotonic:boolean,dataPoints:{_NUMBER}>,histogram:struct<aggregationTemporality:string,dataPoints:{_HISTOGRAM}>,"
    f"exponentialHistogram:struct<aggregationTemporality:string,dataPoints:{_EXP}>,summary:struct<dataPoints:{_SUMMARY}>>>>>>>"
)
SCALE = 1000


def any_text(v: Column) -> Column:
    """An attribute value as text: composite ones stay JSON, a missing one is empty."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["arrayValue"], v["kvlistValue"], v["bytesValue"], F.lit(""))


def attrs(kv: Column) -> Column:
    return F.transform(F.coalesce(kv, F.array().cast(KV)), lambda a: F.struct(a["key"].alias("key"), any_text(a["value"]).alias("value")))


def attr_map(kv: Column) -> Column:
    """Attributes as a map; of repeated keys the last."""
    return F.map_from_entries(last_entries(attrs(kv)))


def resource_attr(kv: Column, name: str) -> Column:
    """The last value of an attribute, "" without one."""
    named = F.filter(F.coalesce(kv, F.array().cast(KV)), lambda a: a["key"] == name)
    return F.coalesce(F.try_element_at(F.transform(named, lambda a: any_text(a["value"])), F.lit(-1)), F.lit(""))


def _now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def _time(text: Column) -> Column:
    t = F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(t > 0, t).otherwise(_now_ns())


def _bad_id(text: Column, length: int) -> Column:
    """A given id of the wrong length or with other signs than hexadecimal digits."""
    return (F.coalesce(text, F.lit("")) != "") & ~F.lower(text).rlike(f"^[0-9a-f]{{{length}}}$")


_CORRUPT = "unreadable string"


def _each(requests: DataFrame, schema: str, groups: str, scopes: str, records: str, *more: str) -> DataFrame:
    """(res, x, unreadable, ...): each record of each scope of each group; a request that can't be read is one row without a record.

    Levels are taken apart one after the other, so that a null or empty one costs its own records only.
    """
    read = F.from_json("json", f"{schema}, {_CORRUPT}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})
    r = requests.select(read.alias("r"))
    bad = F.col("r").isNull() | (F.col("r.unreadable").isNotNull() & F.col(f"r.{groups}").isNull())
    for name, inner, keep in (("g", F.col(f"r.{groups}"), []), ("s", F.col(f"g.{scopes}"), ["g"]), ("x", F.col(f"s.{records}"), ["g", "s"])):
        kind = r.select(inner.alias("i")).schema["i"].dataType
        flag = bad if name == "g" else F.col("unreadable")
        r = r.select(*keep, flag.alias("unreadable"), F.explode(F.when(flag, F.array(F.lit(None).cast(kind.elementType))).otherwise(inner)).alias(name))
    return r.select(F.col("g.resource.attributes").alias("res"), *[F.col(f"s.{c}").alias(a) for c, a in (m.split(" ") for m in more)], "x", "unreadable")


def logs(requests: DataFrame) -> DataFrame:
    """Log records of requests (column json): the columns of stored logs and reject, null for accepted ones. A time of 0 is now.

    A request that can't be read gives one row, rejected as "json".
    """
    r = _each(requests, LOGS, "resourceLogs", "scopeLogs", "logRecords").withColumnRenamed("x", "l")
    ts = _time(F.col("l.timeUnixNano"))
    return r.select(
        new_entry_id(nanos_to_millis(ts)).alias("id"),
        ts.alias("ts_ns"),
        F.timestamp_micros(F.floor(ts / 1000)).alias("ts"),
        severity_level(F.col("l.severityText"), F.coalesce("l.severityNumber", F.lit(0))).alias("level"),
        resource_attr(F.col("res"), "service.name").alias("service"),
        resource_attr(F.col("res"), "host.name").alias("host"),
        hex_id(F.col("l.traceId"), 32).alias("trace_id"),
        hex_id(F.col("l.spanId"), 16).alias("span_id"),
        any_text(F.col("l.body")).alias("body"),
        attrs(F.col("l.attributes")).alias("attrs"),
        F.when(F.col("unreadable"), "json").when(_bad_id(F.col("l.traceId"), 32), "trace_id").when(_bad_id(F.col("l.spanId"), 16), "span_id").alias("reject"),
    )


def spans(requests: DataFrame) -> DataFrame:
    """Spans of requests (column json): the columns of stored spans and reject, null for accepted ones, "json" for a request that can't be read."""
    r = _each(requests, SPANS, "resourceSpans", "scopeSpans", "spans").withColumnRenamed("x", "s")
    start = _time(F.col("s.startTimeUnixNano"))
    trace, span = hex_id(F.col("s.traceId"), 32), hex_id(F.col("s.spanId"), 16)
    return r.select(
        new_entry_id(nanos_to_millis(start)).alias("id"),
        trace.alias("trace_id"),
        span.alias("span_id"),
        hex_id(F.col("s.parentSpanId"), 16).alias("parent_id"),
        resource_attr(F.col("res"), "service.name").alias("service"),
        F.coalesce("s.name", F.lit("")).alias("operation"),
        start.alias("start_ns"),
        F.greatest(start, _time(F.col("s.endTimeUnixNano"))).alias("end_ns"),
        span_status(F.coalesce("s.status.code", F.lit(""))).alias("status"),
        attrs(F.col("s.attributes")).alias("attrs"),
        F.when(F.col("unreadable"), "json").when(trace.isNull(), "trace_id").when(span.isNull(), "span_id").when(_bad_id(F.col("s.parentSpanId"), 16), "parent_id").alias("reject"),
    )


def _metrics(requests: DataFrame) -> DataFrame:
    return _each(requests, METRICS, "resourceMetrics", "scopeMetrics", "metrics", "scope.attributes scope").withColumnRenamed("x", "m")


def _cumulative(temporality: Column) -> Column:
    return F.coalesce(temporality.isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), F.lit(False))


def samples(requests: DataFrame, scale: int = SCALE) -> DataFrame:
    """Scalar samples of requests: gauges and monotonic cumulative sums, with reject for the rest ("sum_temporality", "value",
    and "json" for a request that can't be read, which gives one row).

    Values are stored times scale, rounded; NaN, infinities and what is too large are rejected.
    """
    m = _metrics(requests)
    kind = F.when(F.col("m.gauge").isNotNull(), "gauge").when(F.col("m.sum").isNotNull(), "counter")
    wrong = F.col("m.sum").isNotNull() & ~(_cumulative(F.col("m.sum.aggregationTemporality")) & F.coalesce("m.sum.isMonotonic", F.lit(False)))
    points = F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")
    points = F.when(F.col("unreadable"), F.array(F.lit(None).cast(m.select(points.alias("p")).schema["p"].dataType.elementType))).otherwise(points)
    rows = m.select("res", "scope", F.col("m.name").alias("name"), kind.alias("type"), wrong.alias("bad"), "unreadable", F.explode(points).alias("p"))
    labels = otlp_labels(F.col("name"), attr_map(F.col("res")), attr_map(F.col("scope")), attr_map(F.col("p.attributes")), scale)
    value = scaled_value(F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("double")), scale)
    out = rows.select(labels.alias("labels"), "type", nanos_to_millis(_time(F.col("p.timeUnixNano"))).alias("ts_ms"), value.alias("value"), F.when(F.col("unreadable"), "json").when(F.col("bad"), "sum_temporality").when(value.isNull(), "value").alias("reject"))
    return out.select(series_key(F.col("labels")).alias("series_key"), "*")


def _longs(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda c: c.try_cast("bigint"))


def _bad_counts(*texts: Column) -> Column:
    """Whether one of the counts, each a text or an array of texts, is given but isn't a whole number from 0 on."""
    bad = lambda c: c.isNotNull() & (F.coalesce(c.try_cast("bigint"), F.lit(-1).cast("bigint")) < 0)
    return F.exists(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in texts)), bad)


def explicit_histograms(requests: DataFrame) -> DataFrame:
    """Explicit-bucket histograms of requests; reject is "histogram_temporality" unless they are cumulative, "count" where a count isn't a whole number."""
    rows = _metrics(requests).filter("m.histogram IS NOT NULL").select("res", "scope", F.col("m.name").alias("name"), _cumulative(F.col("m.histogram.aggregationTemporality")).alias("ok"), F.explode("m.histogram.dataPoints").alias("p"))
    labels = otlp_labels(F.col("name"), attr_map(F.col("res")), attr_map(F.col("scope")), attr_map(F.col("p.attributes")))
    out = rows.select(
        labels.alias("labels"), nanos_to_millis(_time(F.col("p.timeUnixNano"))).alias("ts_ms"), F.coalesce("p.explicitBounds", F.array().cast("array<double>")).alias("bounds"), _longs(F.col("p.bucketCounts")).alias("counts"),
        "p.sum", F.col("p.count").try_cast("bigint").alias("count"), "p.min", "p.max",
        F.when(~F.col("ok"), "histogram_temporality").when(_bad_counts(F.array("p.count"), F.col("p.bucketCounts")), "count").alias("reject"),
    )
    return out.select(series_key(F.col("labels")).alias("series_key"), "*")


def exp_histograms(requests: DataFrame) -> DataFrame:
    """Exponential histograms of requests; reject is "exphistogram_temporality" unless they are cumulative, "count" where a count isn't a whole number."""
    rows = _metrics(requests).filter("m.exponentialHistogram IS NOT NULL").select("res", "scope", F.col("m.name").alias("name"), _cumulative(F.col("m.exponentialHistogram.aggregationTemporality")).alias("ok"), F.explode("m.exponentialHistogram.dataPoints").alias("p"))
    labels = otlp_labels(F.col("name"), attr_map(F.col("res")), attr_map(F.col("scope")), attr_map(F.col("p.attributes")))
    side = lambda s: F.struct(F.coalesce(F.col(f"p.{s}.offset"), F.lit(0)).alias("offset"), _longs(F.col(f"p.{s}.bucketCounts")).alias("counts"))
    out = rows.select(
        labels.alias("labels"), nanos_to_millis(_time(F.col("p.timeUnixNano"))).alias("ts_ms"), "p.scale", F.coalesce("p.zeroThreshold", F.lit(0.0)).alias("zero_threshold"), F.coalesce(F.col("p.zeroCount").try_cast("bigint"), F.lit(0)).alias("zero_count"),
        side("positive").alias("pos"), side("negative").alias("neg"), "p.sum", F.col("p.count").try_cast("bigint").alias("count"), "p.min", "p.max",
        F.when(~F.col("ok"), "exphistogram_temporality").when(_bad_counts(F.array("p.count", "p.zeroCount"), F.col("p.positive.bucketCounts"), F.col("p.negative.bucketCounts")), "count").alias("reject"),
    )
    return out.select(series_key(F.col("labels")).alias("series_key"), "*")


def summary_samples(requests: DataFrame, scale: int = SCALE) -> DataFrame:
    """Gauge samples of the quantiles of summaries, one for each quantile, told apart by the label quantile."""
    rows = _metrics(requests).filter("m.summary IS NOT NULL").select("res", "scope", F.col("m.name").alias("name"), F.explode("m.summary.dataPoints").alias("p")).select("*", F.explode("p.quantileValues").alias("q"))
    labels = otlp_labels(F.col("name"), attr_map(F.col("res")), attr_map(F.col("scope")), attr_map(F.col("p.attributes")), scale)
    out = rows.select(quantile_labels(labels, F.col("q.quantile")).alias("labels"), F.lit("gauge").alias("type"), nanos_to_millis(_time(F.col("p.timeUnixNano"))).alias("ts_ms"), scaled_value(F.col("q.value"), scale).alias("value"))
    return out.filter("value IS NOT NULL").select(series_key(F.col("labels")).alias("series_key"), "*")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reject IS NULL").drop("reject")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("reject IS NOT NULL")


def unsupported(requests: DataFrame) -> DataFrame:
    """(reason, points) of the metrics of requests that the store doesn't take: the points of sums and histograms of the wrong
    temporality, and one for each metric without known data ("unknown"). A request that can't be read is not among them."""
    m = _metrics(requests).filter(~F.col("unreadable"))
    wrong = lambda kind: ~_cumulative(F.col(f"m.{kind}.aggregationTemporality"))
    points = lambda kind: F.coalesce(F.size(f"m.{kind}.dataPoints"), F.lit(0))
    has = lambda kind: F.col(f"m.{kind}").isNotNull()
    cases = [
        (has("gauge") | has("summary"), None, F.lit(0)),
        (has("sum"), F.when(wrong("sum") | ~F.coalesce("m.sum.isMonotonic", F.lit(False)), "sum_temporality"), points("sum")),
        (has("histogram"), F.when(wrong("histogram"), "histogram_temporality"), points("histogram")),
        (has("exponentialHistogram"), F.when(wrong("exponentialHistogram"), "exphistogram_temporality"), points("exponentialHistogram")),
    ]
    reason, n = F.lit("unknown"), F.lit(1)
    for case, why, size in reversed(cases):
        reason, n = F.when(case, why).otherwise(reason), F.when(case, size).otherwise(n)
    return m.select(reason.alias("reason"), n.alias("n")).filter("reason IS NOT NULL AND n > 0").groupBy("reason").agg(F.sum("n").alias("points"))


#: Reasons for which a point is left out as unsupported, not as wrong.
UNSUPPORTED = ("sum_temporality", "histogram_temporality", "exphistogram_temporality")


def counts(rows: DataFrame) -> DataFrame:
    """(accepted, rejected, unsupported) of one batch of records."""
    why = F.col("reject")
    return rows.agg(F.count_if(why.isNull()).alias("accepted"), F.count_if(why.isNotNull() & ~why.isin(*UNSUPPORTED)).alias("rejected"), F.count_if(F.coalesce(why.isin(*UNSUPPORTED), F.lit(False))).alias("unsupported"))
