"""Code lists and their labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from contexture.functions.order import text

# Incident categories, severities, and the categories that
# describe the weather itself and so are not incidents.
CATEGORY_LABELS = {
    0: "Unknown",
    1: "Accident",
    2: "Fog",
    3: "Dangerous Conditions",
    4: "Rain",
    5: "Ice",
    6: "Lane Closure",
    7: "Road Closure",
    8: "Road Closed",
    9: "Road Works",
    10: "Wind",
    11: "Flooding",
    14: "Broken Down Vehicle",
}
SEVERITY_LABELS = {
    0: "Undefined",
    1: "Minor",
    2: "Moderate",
    3: "Major",
    4: "Undefined",
}
UNKNOWN_SEVERITY = "Unknown"
CONTEXT_CATEGORIES = (2, 4, 5, 10, 11)

# Every label ``severity_label`` can give: the columns of the severity pivot.
SEVERITIES = tuple(sorted({*SEVERITY_LABELS.values(), UNKNOWN_SEVERITY}))


def lookup(code: Column, labels: Mapping[int, str], default: Column) -> Column:
    """Label of a code, or ``default`` where the code is unlisted or null."""
    pairs = ", ".join(f"{code}, {text(label)}" for code, label in labels.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), code), default)


def category_label(code: Column) -> Column:
    """Unlisted codes read ``Category <code>``, a missing one ``Category None``."""
    spelled = F.coalesce(code.cast("string"), F.lit("None"))
    return lookup(code, CATEGORY_LABELS, F.concat(F.lit("Category "), spelled))


def severity_label(code: Column) -> Column:
    return lookup(code, SEVERITY_LABELS, F.lit(UNKNOWN_SEVERITY))


def is_context_category(
    code: Column, categories: Iterable[int] = CONTEXT_CATEGORIES
) -> Column:
    """True for listed categories; false, never null, for a missing code."""
    return F.coalesce(code.isin(*categories), F.lit(False))
