"""Log arrays in plain JSON, generated data, and self-observation as samples."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tarnlight.functions.scalars import hex_id, new_entry_id, parse_level, series_key
from tarnlight.schema import SAMPLES

ENTRIES = "array<struct<level:string,service:string,host:string,body:string,trace_id:string,span_id:string,attrs:map<string,string>>>"
MAX_TEXT = 65_535


def logs(requests: DataFrame) -> DataFrame:
    """Logs of requests (column json) that hold an array of entries; they have no time of their own and get that of arrival.

    reject names what is wrong with an entry; the others of its request are accepted. A request that isn't such an array gives
    one row, rejected as "json".
    """
    read = F.from_json("json", ENTRIES)
    kind = requests.select(read.alias("r")).schema["r"].dataType.elementType
    e = requests.select(read.isNull().alias("unreadable"), F.explode(F.coalesce(read, F.array(F.lit(None).cast(kind)))).alias("e"))
    now = F.unix_micros(F.current_timestamp()) * 1000
    bad = lambda c, n: (F.coalesce(F.col(c), F.lit("")) != "") & hex_id(F.col(c), n).isNull() & ~F.col(c).rlike("^0+$")
    long = F.greatest(*[F.coalesce(F.octet_length(c), F.lit(0)) for c in ("e.service", "e.host")]) > MAX_TEXT
    return e.select(
        new_entry_id(F.floor(now / 1_000_000)).alias("id"), now.alias("ts_ns"), F.current_timestamp().alias("ts"), parse_level(F.coalesce("e.level", F.lit(""))).alias("level"),
        F.coalesce("e.service", F.lit("")).alias("service"), F.coalesce("e.host", F.lit("")).alias("host"), hex_id(F.col("e.trace_id"), 32).alias("trace_id"), hex_id(F.col("e.span_id"), 16).alias("span_id"),
        F.coalesce("e.body", F.lit("")).alias("body"), F.coalesce(F.map_entries("e.attrs"), F.array().cast("array<struct<key:string,value:string>>")).alias("attrs"),
        F.when(F.col("unreadable"), "json").when(bad("e.trace_id", 32), "trace_id").when(bad("e.span_id", 16), "span_id").when(long, "too_long").alias("reject"),
    )


def generated_logs(spark: SparkSession, rows: int, start_ns: int, span_ns: int) -> DataFrame:
    """Made-up logs spread evenly over a time, the same for the same arguments."""
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    ts = F.lit(start_ns) + (F.col("id") * F.lit(span_ns / max(rows, 1))).cast("bigint")
    return spark.range(rows).select(
        F.unhex(F.lpad(F.hex("id"), 32, "0")).alias("id"), ts.alias("ts_ns"), F.timestamp_micros(F.floor(ts / 1000)).alias("ts"), pick(["DEBUG", "INFO", "WARN", "ERROR"], 1).alias("level"),
        pick(["checkout", "search", "users", "billing"], 2).alias("service"), F.concat(F.lit("node-"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)).cast("string")).alias("host"),
        F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), pick(["slow answer from cache", "order accepted", "connection refused", "health check passed"], 4).alias("body"),
        F.array(F.struct(F.lit("zone").alias("key"), pick(["a", "b"], 5).alias("value"))).alias("attrs"), F.col("id").alias("ingest_seq"),
    )


class SelfObservation(StreamingQueryListener):
    """Keeps the progress of streaming queries; samples() gives it as metric samples."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        now = int(time.time() * 1000)
        for name, value in (("stream_input_rows", p.numInputRows), ("stream_batch_ms", int(p.batchDuration or 0))):
            self.seen.append((name, p.name or str(p.id), now, int(value)))

    def onQueryTerminated(self, event) -> None:
        pass

    def samples(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.seen, "name string, query string, ts_ms bigint, value bigint")
        labels = F.create_map(F.lit("__name__"), F.col("name"), F.lit("query"), F.col("query"))
        return rows.select(series_key(labels).alias("series_key"), labels.alias("labels"), F.lit("gauge").alias("type"), "ts_ms", "value", F.lit(0).cast("bigint").alias("ingest_seq")).to(spark.createDataFrame([], SAMPLES).schema)
