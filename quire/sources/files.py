"""File listings as DataFrames: folders, and archives given as member rows (archive, position, name,
size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.common import ranked
from quire.operators.files import file_kind


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime")


def archive_info(members: DataFrame) -> DataFrame:
    """Per archive: files, bytes, videos; folders are not files but their sizes count."""
    is_file = ~F.col("name").endswith("/")
    return members.groupBy("archive").agg(
        F.count_if(is_file).alias("files"), F.sum("size").alias("bytes"), F.count_if(is_file & (file_kind(F.col("name")) == "video")).alias("videos")
    )


def archive_preview(members: DataFrame, preview: int | None = None) -> DataFrame:
    """The files of each archive in archive order: the first `preview`, or all."""
    return ranked(members.where(~F.col("name").endswith("/")), ["archive"], [F.col("position")], preview, "place").select("archive", "place", "name")


def extractable(members: DataFrame) -> DataFrame:
    """Members that an extraction writes: no folders, no resource forks."""
    return members.where(~F.col("name").endswith("/") & ~F.col("name").startswith("__MACOSX"))
