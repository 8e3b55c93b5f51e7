"""Small files in a folder that Spark can reach, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def read(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: written beside its place and moved there; a file of that name is replaced."""
    fs, where = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{where.getName()}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} was not written")


def move(spark: SparkSession, path: str, to: str) -> None:
    """A file or folder to a place where nothing is, below a folder that need not be there yet."""
    fs, where = _at(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(new.getParent())
    if fs.exists(new) or not fs.rename(where, new):
        raise OSError(f"{path} was not moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
