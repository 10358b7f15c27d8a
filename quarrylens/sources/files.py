"""Source files in a folder or a store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path below root, bytes and modified of every file whose name matches; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select(_below(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path below root and content of every file whose name matches, as UTF-8 text."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(root, wholetext=True)
    return files.select(_below(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))


def _below(path, root: str):
    """The part of a file's URI that follows the root's own path."""
    inside = root.split("://")[-1].removeprefix("file:").strip("/")
    return F.url_decode(F.substring_index(path, inside + "/", -1))
