"""A pipeline over documents made of the operators in tarnlight.llm.

Each stage works on all that the stage before it kept, and returns the columns of documents; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm import byte_bpe, decontaminate, line_frequency, secret_scan, simhash_dedup
from tarnlight.llm.common import read
from tarnlight.sources.paths import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many documents of a source share and the documents that hardly have others.

    Null, empty and blank texts go; texts may be of any length; a null source is one of its own; repeated rows all stay or all
    go. Columns may have any names.
    """
    return line_frequency.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group of near duplicates; rows without an id or with another's are rows like others.

    Repeated rows are duplicates of each other; null, empty and wordless texts all stay; texts may be of any length. Columns
    may have any names.
    """
    return simhash_dedup.drop_duplicate_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a benchmark item, verbatim or edited, whatever their ids.

    Null and empty texts stay; texts may be of any length; repeated rows all stay or all go. Columns may have any names.
    """
    return decontaminate.drop_leaking_rows(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null and empty texts as they are, texts of any length, repeated rows alike."""
    return secret_scan.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their text and whether these give the same bytes again; null for a null text, no ids for an empty one."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: SQL has no SimHash, alignment, network or tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next. An empty table stays empty."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
