"""Structured Streaming: ingest of records, live tail, limits on attributes and series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlight.operators.search import LogQuery, matching
from tarnlight.sources import otlp


@dataclass(frozen=True)
class Guard:
    """Limits on the attributes of one record and of all of a service; 0 is none."""

    max_attrs: int = 0
    max_value_bytes: int = 0
    max_keys_per_service: int = 0
    max_services: int = 0

    def static_reject(self) -> Column:
        """What is wrong with a record by itself, or null."""
        out = F.lit(None).cast("string")
        if self.max_value_bytes:
            out = F.when(F.exists("attrs", lambda a: F.octet_length(a["value"]) > self.max_value_bytes), "attr_value_too_long").otherwise(out)
        if self.max_attrs:
            out = F.when(F.size("attrs") > self.max_attrs, "attrs_per_entry").otherwise(out)
        return out


def requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of request files, one JSON text each."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("wholetext", True).text(path).withColumnRenamed("value", "json")


def start_ingest(rows: DataFrame, path: str, checkpoint: str, rejects: str | None = None, guard: Guard | None = None, **trigger) -> StreamingQuery:
    """Appends accepted records (logs, spans, samples or histograms with reject) to a stored table, and rejected ones beside it.

    Each batch is written once under its number: one that is run again after a failure replaces its own files, so no record is
    stored twice. With a guard records (service, attrs, ...) are held to its limits over the whole stream; the keys that it has
    seen are kept beside the table, each batch's new ones under its number too.
    """
    known = f"{path}-keys"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        if guard is not None:
            before = spark.createDataFrame([], KEYS)
            if number:
                before = spark.read.schema(f"{KEYS}, batch bigint").parquet(known).filter(F.col("batch") < number).select("service", "key")
            checked, fresh = guard_batch(batch, before, guard)
            fresh.write.mode("overwrite").parquet(f"{known}/batch={number}")
        else:
            checked = batch
        otlp.accepted(checked).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if rejects:
            otlp.rejected(checked).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


KEYS = "service string, key string"


def guard_batch(records: DataFrame, known: DataFrame, guard: Guard) -> tuple[DataFrame, DataFrame]:
    """Records (service, attrs, reject, ...) of one batch with what breaks a limit rejected, and the new (service, key) of those accepted.

    known are the keys of the batches before. Of new services, and of a service's new keys, as many are let in as the limits
    leave room for, the first by name. No service is gathered in one task: keys are made distinct and cut to the limit before
    they meet, and records get their service's few allowed keys by a join. A record without keys has the key "", which only makes its service known.
    """
    names = records.columns
    reject = F.coalesce("reject", guard.static_reject()) if "reject" in names else guard.static_reject()
    rows = records.withColumn("reject", reject)
    own = F.when(F.size("attrs") > 0, F.array_distinct("attrs.key")).otherwise(F.array(F.lit("")))
    keys = lambda df: df.filter("reject IS NULL").select("service", F.explode(own).alias("key")).distinct()
    new = keys(rows).join(known, ["service", "key"], "left_anti")
    if guard.max_services:
        old = known.select("service").distinct()
        room = max(0, guard.max_services - old.count())
        let_in = new.select("service").distinct().join(old, "service", "left_anti").orderBy("service").limit(room).union(old)
        rows = rows.join(let_in.withColumn("_in", F.lit(True)), "service", "left")
        rows = rows.withColumn("reject", F.coalesce("reject", F.when(F.col("_in").isNull(), "service_cardinality"))).drop("_in")
        new = new.join(let_in, "service", "left_semi")
    if guard.max_keys_per_service:
        limit, by_name = guard.max_keys_per_service, Window.partitionBy("service").orderBy("key")
        taken = known.filter("key <> ''").groupBy("service").count()
        first = new.filter("key <> ''").withColumn("_nth", F.row_number().over(by_name)).filter(F.col("_nth") <= limit).join(taken, "service", "left").filter(F.col("_nth") + F.coalesce("count", F.lit(0)) <= limit)
        allowed = first.select("service", "key").union(known.select("service", "key")).groupBy("service").agg(F.collect_set("key").alias("_allowed"))
        rows = rows.join(allowed, "service", "left")
        beyond = F.size(F.array_except(F.array_distinct("attrs.key"), F.coalesce("_allowed", F.array().cast("array<string>")))) > 0
        rows = rows.withColumn("reject", F.coalesce("reject", F.when(beyond, "key_cardinality"))).drop("_allowed")
    checked = rows.select(*[c for c in names if c != "reject"], "reject")
    return checked, keys(checked).join(known, ["service", "key"], "left_anti")


def tail(logs: DataFrame, query: LogQuery, delay: str = "10 minutes") -> DataFrame:
    """A live tail: matching logs of a stream, each id once however often it arrives within the delay."""
    return matching(logs, query).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def guard_keys(records: DataFrame, guard: Guard) -> DataFrame:
    """A stream or table of records (service, attrs, ...) with reject: the first limit that a record breaks, or null.

    Distinct attribute keys are counted for each service over the whole stream. A record with a key beyond the limit is
    rejected and its keys aren't counted; records with known keys still pass. Order within a batch is as it arrives.
    """
    checked = records.withColumn("reject", guard.static_reject())
    if not guard.max_keys_per_service:
        return checked
    limit = guard.max_keys_per_service
    names = checked.columns

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        for frame in frames:
            out = []
            for attrs, reject in zip(frame["attrs"], frame["reject"]):
                new = {a["key"] for a in attrs} - known
                if not pd.isna(reject):
                    out.append(reject)
                elif len(known) + len(new) > limit:
                    out.append("key_cardinality")
                else:
                    known |= new
                    out.append(None)
            yield frame.assign(reject=pd.Series(out, dtype="object", index=frame.index))[names]
        state.update((sorted(known),))

    return checked.groupBy("service").applyInPandasWithState(admit, checked.schema, "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def series_rejects(samples: DataFrame, known: DataFrame, max_series: int, max_labels: int = 0, max_label_bytes: int = 0) -> DataFrame:
    """Samples with reject: "labels" or "label_bytes" for too many or too large ones, "label_name" for an empty name, "series" for new series beyond max_series.

    known (series_key) are the series there are already; of new ones the first by key are taken.
    """
    entries = F.map_entries("labels")
    reject = F.when(F.exists(entries, lambda e: e["key"] == ""), "label_name")
    if max_labels:
        reject = reject.when(F.size("labels") > max_labels, "labels")
    if max_label_bytes:
        reject = reject.when(F.aggregate(entries, F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"])) > max_label_bytes, "label_bytes")
    rows = samples.withColumn("reject", reject)
    room = max(0, max_series - known.count())
    fresh = rows.filter("reject IS NULL").select("series_key").distinct().join(known, "series_key", "left_anti").orderBy("series_key")
    taken = fresh.limit(room).union(known.select("series_key")).withColumn("_taken", F.lit(True))
    joined = rows.join(taken, "series_key", "left")
    return joined.withColumn("reject", F.when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("_taken").isNull(), "series")).drop("_taken").select(*rows.columns)
