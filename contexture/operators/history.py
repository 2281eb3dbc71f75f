"""First-per-key history and newest-first listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.functions.order import quoted


def first_per_key(
    joined: DataFrame, key: str = "t_id", time: str = "t_start"
) -> DataFrame:
    """The earliest row of each key; rows alike in time go by the other columns.

    The rank limit is applied before the shuffle as well as after, so a key
    holding a third of all rows sends one row per map task.
    """
    rest = [c for c in joined.columns if c not in (key, time)]
    order = ", ".join(f"{quoted(c)} ASC NULLS LAST" for c in (time, *rest))
    rank = f"row_number() OVER (PARTITION BY {quoted(key)} ORDER BY {order})"
    return joined.selectExpr("*", f"{rank} AS _rank").where("_rank = 1").drop("_rank")


def latest(
    joined: DataFrame, limit: int = 100, time: str = "t_start", key: str = "t_id"
) -> DataFrame:
    """The ``limit`` newest rows, kept as a bounded heap per task."""
    return newest_first(joined, time, key).limit(limit)


def history(
    joined: DataFrame, limit: int = 500, key: str = "t_id", time: str = "t_start"
) -> DataFrame:
    """The earliest row of each key, newest first, ``limit`` of them."""
    return latest(first_per_key(joined, key, time), limit, time, key)


def newest_first(
    joined: DataFrame, time: str = "t_start", key: str = "t_id"
) -> DataFrame:
    """Every row, newest first.

    Sorting by all columns lets the range partitioning cut through a run of
    equal times.
    """
    rest = [c for c in joined.columns if c not in (time, key)]
    order = [F.expr(quoted(c)).asc_nulls_last() for c in (key, *rest)]
    return joined.orderBy(F.expr(quoted(time)).desc_nulls_last(), *order)
