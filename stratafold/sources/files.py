"""Folders and files of any file system that Spark reads: listing, renaming, deleting."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def plain(path: str) -> str:
    """A path without the spellings of a local scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder; none if it is missing or a file."""
    system, where = _at(spark, folder)
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        return []
    return [status.getPath().toString() for status in system.listStatus(where)]


def changed(spark: SparkSession, path: str) -> float:
    """When a path was last changed, in seconds since 1970."""
    system, where = _at(spark, path)
    return system.getFileStatus(where).getModificationTime() / 1000


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, where = _at(spark, path)
    if not system.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"can't rename {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds; nothing happens if it is gone already."""
    system, where = _at(spark, path)
    system.delete(where, True)
