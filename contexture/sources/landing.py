"""Folders into which raw payloads are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_payloads(
    spark: SparkSession, path: str, streaming: bool = False, whole_files: bool = False
) -> DataFrame:
    """Raw payloads as ``value``, one per line or (``whole_files``) one per file.

    Lines are the splittable form and the one for large volumes.
    """
    reader = spark.readStream if streaming else spark.read
    return reader.text(path, wholetext=whole_files)
