"""JSON records as message values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(df: DataFrame) -> DataFrame:
    """All columns of a row as one JSON object in ``value``."""
    # Null fields are written out, so a reader sees every key.
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(row.alias("value"))


def decode(value: Column, schema: T.StructType) -> Column:
    """Message value (text or bytes) to a struct; junk gives a struct of nulls."""
    return F.from_json(value.cast("string"), schema)
