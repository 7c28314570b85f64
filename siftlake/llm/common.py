"""Helpers that the training-data operators share: table access, words, and the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.storage import shared_path, stored

__all__ = ["SPACE", "ascii_lower", "file_system", "shared_path", "stored", "table", "words"]

#: Runs of ASCII white space: what separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z only, so that the result doesn't depend on a locale or a Unicode version."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_system(uri: str):
    """The Arrow file system and the path in it; works in tasks as on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
