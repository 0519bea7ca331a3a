"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder set in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder until it ends; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tarnlight-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder, and says how many there were.

    For use when the results that read them have been stored: results are lazy, so nothing can be deleted before.
    """
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
