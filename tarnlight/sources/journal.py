"""The journal of accepted requests: append, replay in order, subsets, retention by time of acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators.maintenance import Retention, select_for_deletion

SCHEMA = "accepted_at bigint, ingest_seq bigint, signal string, fidelity string, payload string"
SIGNALS = ("logs", "traces", "metrics")


def normalised(records: DataFrame, signal: str, accepted_at: str, seq: str = "ingest_seq") -> DataFrame:
    """Records as journal rows, each a JSON object of its columns."""
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}")
    body = F.to_json(F.struct(*[F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in records.dtypes]))
    return records.select(F.col(accepted_at).cast("bigint").alias("accepted_at"), F.col(seq).alias("ingest_seq"), F.lit(signal).alias("signal"), F.lit("normalized").alias("fidelity"), body.alias("payload"))


def append(rows: DataFrame, path: str) -> None:
    rows.select([c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").partitionBy("signal").parquet(path)


def replay(spark: SparkSession, path: str, signal: str | None = None) -> DataFrame:
    """Journal rows in order of acceptance, ties by ingest_seq."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return (rows if signal is None else rows.filter(F.col("signal") == signal)).orderBy("accepted_at", "ingest_seq")


def subset(records: DataFrame, ids: DataFrame, key: str, excluding: bool = False) -> DataFrame:
    """The records whose key is among ids, or isn't."""
    return records.join(ids.select(key), key, "left_anti" if excluding else "left_semi")


def expired(segments: DataFrame, policy: Retention, now_ns: int) -> DataFrame:
    """select_for_deletion() of journal segments, whose max_ts is the last time of acceptance in them."""
    return select_for_deletion(segments, policy, now_ns)
