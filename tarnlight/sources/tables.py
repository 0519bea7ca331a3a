"""The driver's tables as logs, spans, samples and histograms, and stored tables of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.scalars import exp_bucket, explicit_bucket, scaled_value, series_key

EXP_SCALE = 3
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def padded_hex(number: Column, length: int) -> Column:
    return F.lower(F.lpad(F.hex(number), length, "0"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a log record."""
    e = read(spark, sf_dir, "events")
    us = epoch_us(F.col("ts"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "purchase", "INFO").when(F.col("event_type") == "click", "DEBUG").otherwise("TRACE")
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    return e.select(
        F.unhex(padded_hex(F.col("event_id"), 32)).alias("id"),
        (us * 1000).alias("ts_ns"),
        F.timestamp_micros(us).alias("ts"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 6).cast("string")).alias("service"),
        F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("host"),
        padded_hex(F.col("user_id") + 1, 32).alias("trace_id"),
        F.when(F.col("event_id") % 2 == 0, padded_hex(F.col("event_id") % 7 + 1, 16)).alias("span_id"),
        F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string")).alias("body"),
        F.array(attr("k", F.regexp_extract("props", '"k": *([0-9]+)', 1)), attr("event_type", F.col("event_type"))).alias("attrs"),
        F.col("event_id").alias("ingest_seq"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a span; an order is a trace, its first line the root."""
    start = epoch_us(F.col("l_shipdate")) * 1000 + F.col("l_linenumber") * 1_000_000
    return read(spark, sf_dir, "lineitem").select(
        F.unhex(F.concat(padded_hex(F.col("l_orderkey"), 10), padded_hex(F.col("l_linenumber"), 2), padded_hex(F.col("l_partkey"), 10), padded_hex(F.col("l_suppkey"), 10))).alias("id"),
        padded_hex(F.col("l_orderkey"), 32).alias("trace_id"),
        padded_hex(F.col("l_linenumber"), 16).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, padded_hex(F.lit(1), 16)).alias("parent_id"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 5).cast("string")).alias("service"),
        F.concat("l_returnflag", "l_linestatus").alias("operation"),
        start.alias("start_ns"),
        (start + (F.col("l_quantity") * 1_000_000).cast("bigint")).alias("end_ns"),
        F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "OK").otherwise("UNSET").alias("status"),
        F.array(F.struct(F.lit("partkey").alias("key"), F.col("l_partkey").cast("string").alias("value"))).alias("attrs"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_seq"),
    )


def _labels(name: str) -> Column:
    return F.create_map(F.lit("__name__"), F.lit(name), F.lit("event_type"), F.col("event_type"), F.lit("user_bucket"), (F.col("user_id") % 8).cast("string"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value, in thousandths, as a sample of the series of its type and user bucket."""
    labels = _labels("event_value")
    return read(spark, sf_dir, "events").select(series_key(labels).alias("series_key"), labels.alias("labels"), F.lit("gauge").alias("type"), F.floor(epoch_us(F.col("ts")) / 1000).alias("ts_ms"), scaled_value(F.col("value")).alias("value"), F.col("event_id").alias("ingest_seq"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with resets: of each event its value's thousandths since the counter last passed a million."""
    labels = _labels("event_total")
    value = F.pmod(F.col("event_id") * 7919 + scaled_value(F.col("value")), F.lit(1_000_000))
    return read(spark, sf_dir, "events").select(series_key(labels).alias("series_key"), labels.alias("labels"), F.lit("counter").alias("type"), F.floor(epoch_us(F.col("ts")) / 1000).alias("ts_ms"), value.alias("value"), F.col("event_id").alias("ingest_seq"))


def _dense(buckets: Column) -> Column:
    """From a map of index to count the buckets struct: first index and all counts from there."""
    keys = F.map_keys(buckets)
    low = F.array_min(keys)
    counts = F.transform(F.sequence(low, F.array_max(keys)), lambda i: F.coalesce(F.try_element_at(buckets, i), F.lit(0).cast("bigint")))
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(buckets) > 0, F.struct(low.alias("offset"), counts.alias("counts"))).otherwise(F.struct(F.lit(0).alias("offset"), empty.alias("counts")))


def exp_from_values(values: DataFrame, scale: int = EXP_SCALE, zero_threshold: float = 0.0) -> DataFrame:
    """Exponential histograms, one for each series and time, of rows (series_key, labels, ts_ms, value); NaN and null are left out.

    Values of at most zero_threshold, in size, count as zero.
    """
    v = F.col("value")
    kept = values.filter(v.isNotNull() & ~F.isnan(v)).withColumn("sign", F.when(F.abs(v) <= zero_threshold, 0).otherwise(F.signum(v).cast("int")))
    kept = kept.withColumn("index", F.when(F.col("sign") != 0, exp_bucket(F.abs(v), scale)))
    each = kept.groupBy("series_key", "ts_ms", "sign", "index").agg(F.first("labels").alias("labels"), F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    of = lambda sign: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("sign") == sign, F.struct("index", "n"))), lambda x: x.isNotNull()))
    grouped = each.groupBy("series_key", "ts_ms").agg(
        F.first("labels").alias("labels"), F.sum(F.when(F.col("sign") == 0, F.col("n")).otherwise(0)).alias("zero_count"), of(1).alias("p"), of(-1).alias("m"), F.sum("s").alias("sum"), F.sum("n").alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )
    return grouped.select("series_key", "labels", "ts_ms", F.lit(scale).alias("scale"), F.lit(float(zero_threshold)).alias("zero_threshold"), "zero_count", _dense(F.col("p")).alias("pos"), _dense(F.col("m")).alias("neg"), "sum", "count", "min", "max")


def explicit_from_values(values: DataFrame, bounds: list[float]) -> DataFrame:
    """Histograms with given bounds, one for each series and time, of rows (series_key, labels, ts_ms, value); NaN and null are left out."""
    v, b = F.col("value"), F.array(*[F.lit(float(x)) for x in bounds])
    kept = values.filter(v.isNotNull() & ~F.isnan(v)).withColumn("bucket", explicit_bucket(v, b))
    counts = [F.count_if(F.col("bucket") == i) for i in range(len(bounds) + 1)]
    return kept.groupBy("series_key", "ts_ms").agg(F.first("labels").alias("labels"), F.array(*counts).alias("counts"), F.sum("value").alias("sum"), F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max")).select("series_key", "labels", "ts_ms", b.alias("bounds"), "counts", "sum", "count", "min", "max")


def _daily(spark: SparkSession, sf_dir: str, name: str, shift: float) -> DataFrame:
    labels = F.create_map(F.lit("__name__"), F.lit(name), F.lit("event_type"), F.col("event_type"))
    day = F.floor(epoch_us(F.col("ts")) / 86_400_000_000) * 86_400_000
    return read(spark, sf_dir, "events").select(series_key(labels).alias("series_key"), labels.alias("labels"), day.alias("ts_ms"), (F.col("value") - F.lit(shift)).alias("value"))


def exp_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each day and event type, less 100 so that some are negative; scale 3, on odd days 2."""
    values = _daily(spark, sf_dir, "event_duration", 100.003)
    odd = (F.col("ts_ms") / 86_400_000).cast("bigint") % 2 == 1
    return exp_from_values(values.filter(~odd), EXP_SCALE, 1.0).union(exp_from_values(values.filter(odd), EXP_SCALE - 1, 1.0))


def explicit_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explicit_from_values(_daily(spark, sf_dir, "event_size", 0.0), BOUNDS)


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a log record without a time of its own."""
    return read(spark, sf_dir, "documents").select(
        F.unhex(padded_hex(F.col("doc_id"), 32)).alias("id"),
        (F.col("doc_id") * 1_000_000).alias("ts_ns"),
        F.timestamp_micros(F.col("doc_id") * 1000).alias("ts"),
        F.lit("INFO").alias("level"),
        F.col("source").alias("service"),
        F.lit("").alias("host"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("text").alias("body"),
        F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value"))).alias("attrs"),
        F.col("doc_id").alias("ingest_seq"),
    )
