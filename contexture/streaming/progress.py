"""What a running query says about its state."""

from __future__ import annotations

import threading
from collections import defaultdict
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Totals(StreamingQueryListener):
    """Sums over the whole run of every query, from their progress events.

    A query's own ``recentProgress`` forgets old batches; this does not. Use as
    ``with Totals(spark) as totals:`` around the runs, and ``of(query)`` after.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.late: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)
        self.observed: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.over: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> Totals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.batches[run] += 1
        self.late[run] += sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        for name, row in progress.observedMetrics.items():
            for field, value in row.asDict().items():
                self.observed[run][f"{name}.{field}"] += value

    def onQueryTerminated(self, event: Any) -> None:
        self.over[str(event.runId)].set()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[str, Any]:
        """``late`` rows, ``batches`` and ``observed`` sums of an ended query."""
        run = str(query.runId)
        if not self.over[run].wait(seconds):
            raise TimeoutError("the query's last events have not come")
        return {
            "late": self.late[run],
            "batches": self.batches[run],
            "observed": dict(self.observed[run]),
        }


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped because the watermark had passed them, over recent batches.

    For a whole run use ``Totals``.
    """
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def state_report(query: StreamingQuery) -> dict[str, Any]:
    """The last batch: watermark, intake counts, and rows held per operator.

    A watermark that stands still while rows arrive means that one side is
    silent and the other side's state is growing.
    """
    progress = query.lastProgress
    if progress is None:
        return {"batch": None, "watermark": None, "observed": {}, "state": []}
    return {
        "batch": progress["batchId"],
        "watermark": progress["eventTime"].get("watermark"),
        "observed": {
            name: row.asDict() for name, row in (progress["observedMetrics"] or {}).items()
        },
        "state": [
            {
                "operator": operator["operatorName"],
                "rows": operator["numRowsTotal"],
                "bytes": operator["memoryUsedBytes"],
                "late": operator["numRowsDroppedByWatermark"],
            }
            for operator in progress["stateOperators"]
        ],
    }
