"""Small files in the stores that Spark reads, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def inner_path(spark: SparkSession, path: str) -> str:
    """A path inside its store: absolute, without scheme and host."""
    files, place = _at(spark, path)
    return files.makeQualified(place).toUri().getPath()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host of its store, without escapes."""
    files, place = _at(spark, path)
    return files.makeQualified(place).toString()


def read_text(spark: SparkSession, path: str) -> str | None:
    """Whole content of a small file; null if it does not exist."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file. It is written beside and moved, so readers see all of it or the old one."""
    files, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if files.exists(place):
        files.delete(place, False)
    files.rename(beside, place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing if there is none."""
    files, place = _at(spark, path)
    files.delete(place, True)


def entries(spark: SparkSession, path: str) -> dict[str, int]:
    """Names directly below a folder, with their sizes; empty if there is none."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return {}
    return {entry.getPath().getName(): entry.getLen() for entry in files.listStatus(place)}
