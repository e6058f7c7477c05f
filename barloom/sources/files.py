"""Folders as Spark's own file systems see them, whatever the scheme of their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder with the time of their last change, oldest first; none when there is no folder."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    found = [(status.getPath().getName(), status.getModificationTime()) for status in files.listStatus(place)]
    return sorted(found, key=lambda entry: (entry[1], entry[0]))


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
