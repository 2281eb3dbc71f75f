"""Paths on whatever file system the cluster uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _resolve(spark, path)
    return files.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    target, files = _resolve(spark, path)
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    target, files = _resolve(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, whole or not at all; False if there is one already."""
    target, files = _resolve(spark, path)
    if files.exists(target):
        return False
    draft, _ = _resolve(spark, f"{path}.{uuid.uuid4().hex}")
    draft = draft.getParent().suffix(f"/.{draft.getName()}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        return False
    return True


def move(spark: SparkSession, path: str, to: str) -> bool:
    """A file or folder under a new name; False if there is one already."""
    source, files = _resolve(spark, path)
    target, _ = _resolve(spark, to)
    return not files.exists(target) and files.rename(source, target)


def delete(spark: SparkSession, path: str) -> bool:
    target, files = _resolve(spark, path)
    return files.delete(target, True)
