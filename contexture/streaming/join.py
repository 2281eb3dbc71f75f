"""The context join on streams.

Both sides carry the tumbling bucket as their event time and meet on it.
Incidents of a busy bucket spread over ``salts`` keys, by default twice the
number of state partitions.

``first`` keeps the first observation to arrive in a bucket and the first copy
of an incident, and emits at once; the bucket's single row is repeated once per
salt.

``nearest`` waits until the watermark has passed the bucket and then picks as
the batch join does. Observations shrink to the first and last of each slot, at
widths from a tick of the times up to the bucket, and a slot that incidents ask for
gets the ends of its neighbours. An incident meets one row per width, and the
least of these is its answer. No row holds more than ``FAN`` slots of one width, and a slot's
row is repeated for those salts only that ask for it; the aggregates combine
copies on the map side. Times of whole seconds need one width only, for buckets of
up to ``FAN`` seconds, and those to the microsecond two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.functions.order import least, nulls_last_struct, quoted
from contexture.operators.context import (
    BUCKET_SECONDS,
    CONTEXT_COLUMNS,
    TOLERANCE_SECONDS,
)
from contexture.streaming.intake import distinct_incident_stream

#: Slots in a slot of the next width.
FAN = 20_000


def default_salts(spark: SparkSession) -> int:
    """Two for each state partition, so that one bucket's incidents reach most."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class _Buckets:
    """Tumbling buckets, or with ``seconds=None`` all within tolerance.

    In the latter case buckets are as wide as the tolerance, and their rows meet
    in sliding windows three buckets wide: an observation lies in three of them,
    an incident is taken to the one that has it in the middle. Of the outer two
    buckets only the end that faces the middle can be nearest to an incident.
    """

    seconds: int | None
    tolerance: int
    tick: int = 1

    @property
    def micros(self) -> int:
        return (self.seconds or self.tolerance) * 1_000_000

    def at(self, time: str) -> Column:
        """Event time in microseconds; one that is no whole tick fails the query."""
        if self.tick == 1:
            return F.unix_micros(time)
        wrong = f"raise_error('an event time is no multiple of {self.tick} microseconds')"
        at = f"unix_micros({quoted(time)})"
        return F.expr(f"IF({at} % {self.tick} = 0, {at}, CAST({wrong} AS BIGINT))")

    def observed(self, time: str) -> Column:
        if self.seconds:
            return F.window(time, f"{self.seconds} seconds").alias("bucket")
        width = f"{3 * self.tolerance} seconds"
        return F.window(time, width, f"{self.tolerance} seconds").alias("bucket")

    def incidents(self, df: DataFrame, carried: list[str]) -> DataFrame:
        # A stateful operator takes one event-time column, here the bucket, so
        # exact times travel as numbers.
        rows = df.select(
            self.observed("t_start"),
            self.at("t_start").alias("start_micros"),
            *carried,
        )
        if self.seconds:
            return rows
        return rows.where(f"{self.side('start_micros')} = 0")

    def side(self, at: str) -> str:
        """SQL: whether a window's time lies before (-1), in or behind (1) its middle bucket."""
        begin = f"unix_micros(bucket.start) + {self.micros}"
        return f"IF({at} < {begin}, -1, IF({at} >= {begin} + {self.micros}, 1, 0))"


def _first_incidents(incidents: DataFrame, carried: list[str], buckets: _Buckets):
    return buckets.incidents(distinct_incident_stream(incidents), carried)


def _least_incidents(incidents: DataFrame, carried: list[str], buckets: _Buckets):
    rest = [c for c in carried if c != "t_id"]
    rows = buckets.incidents(incidents, carried)
    rows = rows.groupBy("bucket", "start_micros", "t_id").agg(
        least(rest or ["t_id"]).alias("least")
    )
    return rows.selectExpr(
        "bucket",
        "start_micros",
        "t_id",
        *[f"least.{quoted(c)} AS {quoted(c)}" for c in rest],
    )


def _first_per_bucket(
    observations: DataFrame, context: Sequence[str], buckets: _Buckets
):
    rows = observations.select(
        buckets.observed("w_timestamp"),
        F.unix_micros("w_timestamp").alias("at"),
        *context,
    )
    rows = rows.dropDuplicates(["bucket"])
    return rows.select("bucket", F.array(F.struct("at", *context)).alias("seen"))


def _first_met(
    left: DataFrame, observations: DataFrame, context: Sequence[str], buckets, salts: int
) -> DataFrame:
    """Incidents with their bucket's one observation as ``nearest``."""
    right = _first_per_bucket(observations, context, buckets)
    right = right.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS salt")
    fields = ", ".join(f"seen[0].{quoted(c)} AS {quoted(c)}" for c in context)
    return left.join(right, ["bucket", "salt"]).selectExpr(
        "*", f"struct(abs(seen[0].at - start_micros) AS gap, {fields}) AS nearest"
    )


def _slots(bucket_micros: int, tick: int) -> list[str]:
    """SQL of the slots that ``at`` lies in, one per width.

    Widths grow by ``FAN`` from a tick on, so a slot (``node``) holds at
    most ``FAN`` slots of the next smaller width (``child``), and the bucket at
    most ``FAN`` of the widest, and one more where they are not aligned.
    """
    widths = [tick]
    while widths[-1] * FAN < bucket_micros:
        widths.append(widths[-1] * FAN)
    # Floors, also before 1970; a level's node is one child of the next level.
    slots = [f"(at - pmod(at, {w})) DIV {w}" for w in widths]
    nodes = [*slots[1:], "0L"]
    return [
        f"struct({k} AS level, {node} AS node, {child} AS child)"
        for k, (child, node) in enumerate(zip(slots, nodes, strict=True))
    ]


def _levels(buckets: _Buckets) -> str:
    """SQL that explodes ``at`` into the slots it lies in."""
    return f"explode(array({', '.join(_slots(buckets.micros, buckets.tick))})) AS slot"


def _observed_levels(buckets: _Buckets) -> str:
    """The same for observations, of which a window's outer buckets are one slot each.

    These stand beside the widest slots of the middle bucket, before or behind all of them.
    """
    if buckets.seconds:
        return _levels(buckets)
    slots = _slots(buckets.micros, buckets.tick)
    end = f"IF({buckets.side('at')} < 0, {-(2**63) + 1}L, {2**63 - 1}L)"
    outer = f"array(struct({len(slots) - 1} AS level, 0L AS node, {end} AS child))"
    return f"explode(IF({buckets.side('at')} = 0, array({', '.join(slots)}), {outer})) AS slot"


def _nodes(
    asked: DataFrame, observations: DataFrame, context: Sequence[str], buckets: _Buckets
) -> DataFrame:
    """``bucket, level, node, slots, seen``: a node's slots with their ends and the salts that ask.

    Both lists are in order and have at most ``FAN`` entries (and two for the outer
    buckets), whatever the precision of the times. ``seen`` are the slots with observations.
    """
    own = nulls_last_struct(context)
    seen = (
        observations.select(
            buckets.observed("w_timestamp"),
            buckets.at("w_timestamp").alias("at"),
            F.expr(own).alias("own"),
        )
        .selectExpr("bucket", "at", "own", _observed_levels(buckets))
        .selectExpr(
            "bucket",
            "slot.*",
            "struct(at AS key, own) AS first",
            "struct(-at AS key, own) AS last",
        )
    )
    asked = asked.selectExpr("bucket", "start_micros AS at", "salt")
    asked = asked.selectExpr("bucket", "salt", _levels(buckets))
    asked = asked.selectExpr("bucket", "slot.*", "salt")
    # First and last per slot combine on the map side, and so do the salts.
    slots = (
        seen.unionByName(asked, allowMissingColumns=True)
        .groupBy("bucket", "level", "node", "child")
        .agg(
            F.min("first").alias("first"),
            F.min("last").alias("last"),
            F.collect_set("salt").alias("salts"),
        )
    )
    listed = "sort_array(collect_list(struct(child, first, last, salts)))"
    return slots.groupBy("bucket", "level", "node").agg(
        F.expr(listed).alias("slots"),
        F.expr(f"filter({listed}, s -> s.first IS NOT NULL)").alias("seen"),
    )


def _ends(nodes: DataFrame) -> DataFrame:
    """``bucket, level, child, salt, earlier, later`` for the slots that incidents ask for.

    ``earlier`` is the last observation in the slots before this one within the
    same node, ``later`` the first in those behind it; at the lowest level, where
    a slot is one tick, and so one instant, ``earlier`` also looks at the slot itself. Any other
    observation of the bucket lies beside the incident's slot at exactly one
    level, so the ends of all levels hold its neighbours on both sides.

    A node is worked in one pass: on a list of all slots, one with both kinds
    standing there twice, observed first, a slot's place less its rank among those
    asked for is the number of observed slots up to and with it.
    """
    both = """flatten(transform(slots, s -> concat(
        IF(s.first IS NULL, array(), array(struct(s.child AS child, CAST(NULL AS ARRAY<INT>) AS salts))),
        IF(size(s.salts) = 0, array(), array(struct(s.child AS child, s.salts AS salts))))))"""
    placed = f"transform({both}, (s, place) -> struct(s.child AS child, s.salts AS salts, place))"
    before = "get(seen, c.place - rank - 1)"
    found = nodes.selectExpr(
        "bucket",
        "level",
        f"""inline(transform(filter({placed}, c -> c.salts IS NOT NULL), (c, rank) -> struct(
            c.child AS child,
            c.salts AS salts,
            IF(level > 0 AND {before}.child = c.child, get(seen, c.place - rank - 2), {before}).last
                AS earlier,
            get(seen, c.place - rank).first AS later
        )))""",
    )
    return found.where("earlier IS NOT NULL OR later IS NOT NULL").selectExpr(
        "bucket", "level", "child", "explode(salts) AS salt", "earlier", "later"
    )


def _nearest_met(
    left: DataFrame,
    asked: DataFrame,
    observations: DataFrame,
    context: Sequence[str],
    buckets: _Buckets,
) -> DataFrame:
    """Incidents with the least observation by distance, then time, as ``nearest``."""
    right = _ends(_nodes(asked, observations, context, buckets))
    rows = left.selectExpr("*", "start_micros AS at").selectExpr("*", _levels(buckets))
    rows = rows.selectExpr("*", "slot.level AS level", "slot.child AS child").drop("at", "slot")
    # One entry per instant leaves no tie.
    near = """array_min(filter(array(
        struct(start_micros + earlier.key AS gap, -earlier.key AS at, earlier.own AS own),
        struct(later.key - start_micros AS gap, later.key AS at, later.own AS own)
    ), o -> o.gap IS NOT NULL))"""
    kept = [c for c in left.columns if c not in ("bucket", "salt", "start_micros", "t_id")]
    fields = ", ".join(f"near.own.{quoted(c)} AS {quoted(c)}" for c in context)
    met = rows.join(right, ["bucket", "level", "child", "salt"]).selectExpr(
        "bucket", "start_micros", "t_id", *map(quoted, kept), f"{near} AS near"
    )
    if len(_slots(buckets.micros, buckets.tick)) > 1:
        met = met.groupBy("bucket", "start_micros", "t_id").agg(
            F.min("near").alias("near"), *[F.first(quoted(c)).alias(c) for c in kept]
        )
    return met.selectExpr(
        "start_micros", "t_id", *map(quoted, kept), f"struct(near.gap AS gap, {fields}) AS nearest"
    )


def stream_context_join(
    incidents: DataFrame,
    observations: DataFrame,
    match: str = "first",
    bucket_seconds: int | None = BUCKET_SECONDS,
    tolerance_seconds: int = TOLERANCE_SECONDS,
    context: Sequence[str] = CONTEXT_COLUMNS,
    required: str | None = "weather_desc",
    salts: int | None = None,
    tick_micros: int = 1,
) -> DataFrame:
    """Distinct incidents with the ``context`` columns of one observation.

    ``incidents`` are watermarked on ``t_start``, ``observations`` on
    ``w_timestamp``. For ``nearest`` neither may have been combined before.
    ``bucket_seconds=None`` is for ``nearest``: one observation cannot stand for
    all of a bucket whose ends lie further apart than the tolerance. Times are
    multiples of ``tick_micros``; for ``nearest`` it decides how many widths of slots
    are held, and is fixed by a checkpoint's first run.
    """
    salts = salts or default_salts(incidents.sparkSession)
    carried = [c for c in incidents.columns if c != "t_start"]
    tick = tick_micros if match == "nearest" else 1
    buckets = _Buckets(bucket_seconds, tolerance_seconds, tick)
    if match == "first":
        if not bucket_seconds or bucket_seconds > tolerance_seconds:
            raise ValueError("'first' needs a bucket no wider than the tolerance")
        left = _first_incidents(incidents, carried, buckets)
    elif match == "nearest":
        left = _least_incidents(incidents, carried, buckets)
    else:
        raise ValueError(f"match is 'first' or 'nearest', not {match!r}")

    salt = f"CAST(pmod(xxhash64(t_id, start_micros), {salts}) AS INT) AS salt"
    left = left.selectExpr("*", salt)
    if match == "first":
        matched = _first_met(left, observations, context, buckets, salts)
    else:
        asked = buckets.incidents(incidents, ["t_id"]).selectExpr("*", salt)
        matched = _nearest_met(left, asked, observations, context, buckets)
    matched = matched.where(f"nearest.gap <= {tolerance_seconds * 1_000_000}")
    if required:
        matched = matched.where(f"nearest.{quoted(required)} IS NOT NULL")
    start = {"t_start": "timestamp_micros(start_micros) AS t_start"}
    return matched.selectExpr(
        *[start.get(c, quoted(c)) for c in incidents.columns],
        *[f"nearest.{quoted(c)}" for c in context],
    )
