"""What is stored: services, metric names, label values, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.operators.selectors import NAME


def services(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Names of all services that have logs or spans, sorted; partial distinct before the shuffle."""
    return logs.select("service").union(spans.select("service")).filter("service <> ''").distinct().orderBy("service")


def label_values(samples: DataFrame, name: str) -> DataFrame:
    """Distinct values of a label, sorted."""
    return samples.select(F.try_element_at("labels", F.lit(name)).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")


def metric_names(samples: DataFrame) -> DataFrame:
    return label_values(samples, NAME).withColumnRenamed("value", "name")


def series(samples: DataFrame) -> DataFrame:
    """The series and when each was last written: the dimension table that eviction and limits work on."""
    return samples.groupBy("series_key").agg(F.first("labels").alias("labels"), F.first("type").alias("type"), F.max("ts_ms").alias("last_ts"), F.count("*").alias("samples"))


def metric_stats(samples: DataFrame) -> DataFrame:
    """For each metric: series, samples, first and last time."""
    name = F.coalesce(F.try_element_at("labels", F.lit(NAME)), F.lit("")).alias("name")
    per_series = samples.groupBy(name, "series_key").agg(F.count("*").alias("samples"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))
    return per_series.groupBy("name").agg(F.count("*").alias("series"), F.sum("samples").alias("samples"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def log_stats(logs: DataFrame) -> DataFrame:
    """For each service and level: records, bytes of bodies, first and last time."""
    return logs.groupBy("service", "level").agg(F.count("*").alias("records"), F.sum(F.octet_length("body")).alias("body_bytes"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))


def segments(stored: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """Files of a stored table: path, size, records, first and last time."""
    return stored.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes")).agg(F.count("*").alias("records"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def attr_key_cardinality(rows: DataFrame) -> DataFrame:
    """Distinct attribute keys of each service."""
    return rows.select("service", F.explode("attrs.key").alias("key")).groupBy("service").agg(F.count_distinct("key").alias("keys"))
