"""Fields of payloads that no schema names.

Payloads are read a second time as VARIANT, which keeps every field whatever its
kind. The schema is gone down level by level; where a struct of it has a field
more than the schema, that field comes out whole, with its path. Depth and number
of the steps are those of the schema, so a payload may be nested as it likes.
Nothing here shuffles but ``counts``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$"
ITEM = "[*]"
#: Names that stand in a path as they are; others are quoted.
PLAIN = r"^[^.\[\]'\\]+$"
#: Kinds of numbers that one JSON number may be read as.
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE"]


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


def _step(name: Column) -> Column:
    """What a field adds to its struct's path."""
    quoted = F.regexp_replace(name, r"(['\\])", r"\\$1")
    return F.when(name.rlike(PLAIN), F.concat(F.lit("."), name)).otherwise(
        F.concat(F.lit("['"), quoted, F.lit("']"))
    )


def _paths(kind: T.DataType, path: str = ROOT) -> dict[str, T.DataType]:
    """Every path of a schema and what is there."""
    found = {path: kind}
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            plain = re.search(PLAIN, field.name)
            quoted = re.sub(r"(['\\])", r"\\\1", field.name)
            step = f".{field.name}" if plain else f"['{quoted}']"
            found |= _paths(field.dataType, path + step)
    elif isinstance(kind, T.ArrayType):
        found |= _paths(kind.elementType, path + ITEM)
    return found


def _depth(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 1 + max((_depth(f.dataType) for f in kind.fields), default=0)
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def _is(path: Column, paths: list[str]) -> Column:
    return path.isin(paths) if paths else F.lit(False)


def extras(payloads: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """``path, found``: each field that ``schema`` does not name, wherever it stands.

    ``path`` is like ``$.list[*].name``, or ``$['a.name']`` for names with signs; ``found`` is the field with all in it, as
    VARIANT, a JSON null too. A payload that is null or no JSON gives one row with
    the path ``$`` and a null. A value of another kind than the schema has there,
    such as text for a struct, comes out under its own path; scalars of another
    kind are left to the reader of records. Of names that a payload repeats in
    one object, which JSON leaves open, the payload counts as unreadable.
    """
    known = _paths(schema)
    inner = [p for p, kind in known.items() if _nested(kind)]
    lists = [p for p, kind in known.items() if isinstance(kind, T.ArrayType)]
    leaves = [p for p, kind in known.items() if not _nested(kind)]

    rows = payloads.select(F.try_parse_json(F.col(column).cast("string")).alias("found"))
    rows = rows.select(F.lit(ROOT).alias("path"), "found", F.lit(True).alias("open"))
    spark = payloads.sparkSession
    for _ in range(_depth(schema)):
        # Only a node of the kind that the schema has is opened; a null one has no fields.
        shape = F.schema_of_variant("found")
        fits = F.when(_is(F.col("path"), lists), shape.startswith("ARRAY")).otherwise(
            shape.startswith("OBJECT")
        )
        rows = rows.withColumn("open", F.col("open") & F.coalesce(fits, F.lit(False)))
        rows = rows.withColumn("_in", F.when(F.col("open"), F.col("found")))
        parts = spark.tvf.variant_explode_outer(F.col("_in").outer())
        rows = rows.lateralJoin(parts).where("NOT open OR pos IS NOT NULL")
        below = F.concat("path", F.coalesce(_step(F.col("key")), F.lit(ITEM)))
        rows = rows.select(
            F.when(F.col("open"), below).otherwise(F.col("path")).alias("path"),
            F.when(F.col("open"), F.col("value")).otherwise(F.col("found")).alias("found"),
            "open",
        )
        rows = rows.withColumn("open", F.col("open") & _is(F.col("path"), inner))
        rows = rows.where(~_is(F.col("path"), leaves))
    void = _is(F.col("path"), inner) & F.col("found").isNotNull() & F.is_variant_null("found")
    return rows.where(~void).select("path", "found")


def counts(found: DataFrame) -> DataFrame:
    """``path, kind, n``: fields by path and JSON kind; unreadable payloads have none.

    Grouped on the map side first, so a path that all payloads have is one row a task.
    """
    kind = F.schema_of_variant("found")
    kind = F.regexp_extract(kind, r"^[A-Z]+", 0)
    kind = F.when(kind.isin(NUMBERS), "NUMBER").otherwise(kind)
    return found.groupBy("path", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
