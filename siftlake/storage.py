"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}
_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, as a full URI.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session (one machine) may leave it unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="siftlake-")
        _local[spark.sparkContext.applicationId] = base
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    _written.append(uri)
    return uri


def clear(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder, when no result that reads it is needed any more; gives the number of paths."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
