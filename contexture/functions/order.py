"""Total orders over nullable columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as it stands in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal in SQL text."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def nulls_last_struct(columns: Iterable[str]) -> str:
    """SQL for a struct that compares column by column, nulls after all values.

    Structs compare null fields first, so a null flag goes before each field.
    """
    names = [quoted(c) for c in columns]
    return f"struct({', '.join(f'{c} IS NULL, {c} AS {c}' for c in names)})"


def least(columns: Iterable[str]) -> Column:
    """Aggregate: the least combination of ``columns``, nulls last."""
    return F.expr(f"min({nulls_last_struct(columns)})")


def least_row(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the least by ``columns``, nulls last.

    ``min`` combines on the map side, so copies of a hot key leave each map
    task as one row.
    """
    picked = df.groupBy(*keys).agg(least(columns).alias("_least"))
    fields = {c: f"_least.{quoted(c)} AS {quoted(c)}" for c in columns}
    return picked.selectExpr(*[fields.get(c, quoted(c)) for c in df.columns])
