"""Folders of a store that Spark reaches, by the file system of their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names below ``path`` that begin with ``prefix``; none if the path is not there."""
    store, place = _store(spark, path)
    if not store.exists(place):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.getPath().getName().startswith(prefix))


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        store, place = _store(spark, path)
        store.delete(place, True)
