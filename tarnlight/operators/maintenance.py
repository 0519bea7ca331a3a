"""Batch jobs over stored tables: compaction, retention, eviction, verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.scalars import utc_seconds
from tarnlight.functions.tokens import stemmed_tokens


def compact_samples(samples: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """One sample for each series and time, the last written; older ones than the cutoff are dropped first.

    Of writes with equal ingest_seq the greatest value. One shuffle by series and time, before which each task keeps its own last writes only.
    """
    kept = samples if cutoff_ms is None else samples.filter(F.col("ts_ms") >= cutoff_ms)
    last = Window.partitionBy("series_key", "ts_ms").orderBy(F.desc("ingest_seq"), F.desc("value"))
    return kept.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").select("series_key", "labels", "type", "ts_ms", "value", "ingest_seq")


def named(samples: DataFrame) -> DataFrame:
    """samples with metric_name, the label __name__, first: stored tables are partitioned by it, and selectors of a name prune by it."""
    return samples.select(F.coalesce(F.try_element_at("labels", F.lit("__name__")), F.lit("")).alias("metric_name"), "*")


def write_compacted(samples: DataFrame, path: str, cutoff_ms: int | None = None, files: int | None = None) -> None:
    """compact_samples() as Parquet in one folder a metric name, sorted by series and time in files of neighbouring series."""
    rows, keys = named(compact_samples(samples, cutoff_ms)), ("metric_name", "series_key", "ts_ms")
    rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    rows.sortWithinPartitions(*keys).write.partitionBy("metric_name").parquet(path)


def write_series(samples: DataFrame, path: str) -> None:
    """The series of samples (series_key, labels, type, first and last time, number of samples) in one folder a metric name."""
    series = samples.groupBy("series_key").agg(F.first("labels").alias("labels"), F.first("type").alias("type"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.count("*").alias("samples"))
    named(series).repartition("metric_name", "series_key").write.partitionBy("metric_name").parquet(path)


def compact_histograms(ticks: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """All ticks from the cutoff on; none replaces another."""
    return ticks if cutoff_ms is None else ticks.filter(F.col("ts_ms") >= cutoff_ms)


def rewrite_histograms(ticks: DataFrame, path: str, cutoff_ms: int | None = None) -> None:
    """compact_histograms() as Parquet, many small files as fewer, sorted by series and time, in one folder a metric name."""
    keys = ("metric_name", "series_key", "ts_ms")
    named(compact_histograms(ticks, cutoff_ms)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("metric_name").parquet(path)


@dataclass(frozen=True)
class Retention:
    """Limits; 0 is none. They apply in this order, oldest segments first."""

    max_age_ns: int = 0
    max_segments: int = 0
    max_bytes: int = 0


def select_for_deletion(segments: DataFrame, policy: Retention, now_ns: int) -> DataFrame:
    """(segment_id, reason) of the segments (segment_id, max_ts, size_bytes, delete_pending) to delete.

    Marked segments go first, then those whose newest record is too old, then the oldest beyond the allowed number, then the
    oldest until the rest fits the allowed size. Ties by segment_id. One row a file, so one window over all is small.
    """
    newest = Window.orderBy(F.desc("max_ts"), F.desc("segment_id"))
    reason = F.when(F.coalesce("delete_pending", F.lit(False)), "delete_pending")
    if policy.max_age_ns > 0:
        reason = reason.when(F.col("max_ts") < now_ns - policy.max_age_ns, "max_age")
    rows = segments.withColumn("reason", reason)
    gone = rows.filter("reason IS NOT NULL")
    rest = rows.filter("reason IS NULL").withColumn("place", F.row_number().over(newest)).withColumn("bytes", F.sum("size_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    late = F.lit(None).cast("string")
    if policy.max_segments > 0:
        late = F.when(F.col("place") > policy.max_segments, "max_segments")
    if policy.max_bytes > 0:
        late = F.coalesce(late, F.when(F.col("bytes") > policy.max_bytes, "max_total_bytes"))
    return gone.select("segment_id", "reason").union(rest.withColumn("reason", late).filter("reason IS NOT NULL").select("segment_id", "reason"))


def expired_blocks(blocks: DataFrame, cutoff_ms: int) -> DataFrame:
    """Blocks whose last sample is before the cutoff; a block is dropped whole or not at all."""
    return blocks.filter(F.col("max_ts") < cutoff_ms)


def cold_series(samples: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """(series_key, last_ts) of the series without a sample in the retention time; a last time of 0 is unknown and stays."""
    last = samples.groupBy("series_key").agg(F.max("ts_ms").alias("last_ts"))
    return last.filter((F.col("last_ts") <= now_ms - retention_ms) & (F.col("last_ts") != 0))


def fingerprint(df: DataFrame) -> DataFrame:
    """(records, digest): two tables with the same rows, each as often, in any order, have the same. The digest is a sum, in which repeated rows add up."""
    return df.select(F.xxhash64(*[F.to_json(F.struct(F.col("`" + c.replace("`", "``") + "`"))) for c in df.columns]).alias("h")).agg(F.count("*").alias("records"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"))


def copy_table(df: DataFrame, path: str) -> bool:
    """Writes a copy and says whether reading it back gives the same fingerprint."""
    df.write.parquet(path)
    return fingerprint(df).first() == fingerprint(df.sparkSession.read.parquet(path)).first()


def restore_table(spark: SparkSession, copy: str, path: str) -> bool:
    """Writes a copy back to path, which must not be there yet, and says whether it reads like the copy."""
    return copy_table(spark.read.parquet(copy), path)


def drill(df: DataFrame, folder: str) -> bool:
    """A copy of df made and restored beside it; whether both read like df. Both stay in folder."""
    return copy_table(df, f"{folder}/copy") and restore_table(df.sparkSession, f"{folder}/copy", f"{folder}/restored") and fingerprint(df).first() == fingerprint(df.sparkSession.read.parquet(f"{folder}/restored")).first()


def maintain_samples(samples: DataFrame, path: str, now_ms: int, retention_ms: int) -> DataFrame:
    """One round of maintenance: what is in the retention time, compacted, and its series, written below path; returns the series that went cold."""
    write_compacted(samples, f"{path}/samples", now_ms - retention_ms)
    write_series(samples.filter(F.col("ts_ms") >= now_ms - retention_ms), f"{path}/series")
    return cold_series(samples, now_ms, retention_ms)


def write_segments(rows: DataFrame, path: str, ts: str = "ts_ns", max_records: int = 100_000, bloom: str | None = "trace_id") -> None:
    """Appends to a stored table, by day, files of at most max_records rows sorted by time; a Bloom filter for look-ups by trace.

    Rows are spread by ranges of time, so a day with many of them is many tasks' work. Logs get the column tokens, the stems
    of their bodies, which searches for text then read.
    """
    if "body" in rows.columns and "tokens" not in rows.columns:
        rows = rows.withColumn("tokens", stemmed_tokens(F.col("body")))
    day = F.to_date(utc_seconds(F.col(ts)))
    writer = rows.withColumn("day", day).repartitionByRange("day", ts).sortWithinPartitions("day", ts).write.mode("append").partitionBy("day").option("maxRecordsPerFile", max_records)
    if bloom and bloom in rows.columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    writer.parquet(path)
