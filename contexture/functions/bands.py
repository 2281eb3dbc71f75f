"""Named value ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contexture.functions.order import quoted, text


@dataclass(frozen=True)
class Bands:
    """Labels of consecutive ranges; ``bounds[i]`` is where label ``i`` ends.

    A value belongs to the first band whose bound lies above it, and to the
    last label when none does. A null value belongs to no band.
    """

    bounds: Sequence[float]
    labels: Sequence[str]

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.bounds) + 1:
            raise ValueError("there must be one label more than bounds")
        if list(self.bounds) != sorted(set(self.bounds)):
            raise ValueError("bounds must ascend")

    def rank(self, value: str) -> Column:
        """Position of the named column's band, which is its display order."""
        name = quoted(value)
        cases = [f"WHEN {name} < {b} THEN {i}" for i, b in enumerate(self.bounds)]
        return F.expr(
            f"CASE WHEN {name} IS NULL THEN NULL {' '.join(cases)}"
            f" ELSE {len(self.bounds)} END"
        )

    def label_of_rank(self, rank: str) -> Column:
        return F.get(self._labels(), F.col(rank))

    def _labels(self) -> Column:
        return F.expr(f"array({', '.join(text(label) for label in self.labels)})")

    def label(self, value: str) -> Column:
        return F.get(self._labels(), self.rank(value))


# Visibility ranges in metres.
VISIBILITY_BANDS = Bands(
    bounds=(2000, 5000, 10000),
    labels=("Poor (0-2km)", "Moderate (2-5km)", "Good (5-10km)", "Clear (10km+)"),
)
