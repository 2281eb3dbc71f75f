"""Small helpers shared by the operators: written tables and row types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contexture.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage: what a lost executor held is read again, not worked out
    again, and a result used twice is worked out once.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that no column of ``df`` has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
