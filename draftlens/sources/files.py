"""Folders and small files of the shared store, through Hadoop's file systems."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def literal(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file as a whole: readers see the old text or the new one."""
    fs, where = _open(spark, path)
    part = where.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    size = fs.getFileStatus(where).getLen()
    data = fs.open(where)
    try:
        return bytes(data.readNBytes(size)).decode()
    finally:
        data.close()
