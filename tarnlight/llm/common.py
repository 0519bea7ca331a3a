"""What several operators share: the shared folder, written tables and safe column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.sources.paths import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no rerun of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, wish: str = "row_key") -> tuple[DataFrame, str]:
    """df, written to the shared folder with a number of its own for each row, whatever its columns hold, and that column's name."""
    name = free_name(df, wish)
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores before it until no column of df has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def content_key(*columns: str) -> Column:
    """128 bits of the columns' content, as two longs: equal rows have equal keys."""
    cols = [quoted(c) for c in columns]
    return F.struct(F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("tarnlight"), *cols).alias("k2"))
