"""The named queries again as plain SQL, written without the operators.

The join is stated by its definition (all candidate pairs, ranked), which is
fit for a check on small tables only.
"""

from __future__ import annotations

_EVENTS = """
WITH polled AS (
    SELECT *, unnest(CASE WHEN event_id % 4 = 0 THEN [1, 2] ELSE [1] END) AS poll,
           CAST(floor(epoch(ts)) AS BIGINT) AS sec,
           CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS k,
           CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 15 AS INTEGER) END AS category,
           CASE WHEN event_id % 19 <> 0 THEN CAST(user_id % 6 AS INTEGER) END AS magnitude,
           CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 200) AS INTEGER) END AS metres
    FROM events
),
labelled AS (
    SELECT *,
           CASE k WHEN 0 THEN 'Clear' WHEN 1 THEN 'Clouds' WHEN 2 THEN 'Rain'
                  WHEN 3 THEN 'Snow' WHEN 4 THEN 'Mist' END AS condition,
           CASE category
               WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Accident' WHEN 2 THEN 'Fog'
               WHEN 3 THEN 'Dangerous Conditions' WHEN 4 THEN 'Rain' WHEN 5 THEN 'Ice'
               WHEN 6 THEN 'Lane Closure' WHEN 7 THEN 'Road Closure'
               WHEN 8 THEN 'Road Closed' WHEN 9 THEN 'Road Works' WHEN 10 THEN 'Wind'
               WHEN 11 THEN 'Flooding' WHEN 14 THEN 'Broken Down Vehicle'
               ELSE 'Category ' || coalesce(CAST(category AS VARCHAR), 'None')
           END AS category_label,
           CASE magnitude
               WHEN 0 THEN 'Undefined' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Moderate'
               WHEN 3 THEN 'Major' WHEN 4 THEN 'Undefined' ELSE 'Unknown'
           END AS severity_label
    FROM polled
),
weather_in AS (
    SELECT sec AS w, condition AS weather_desc, metres AS visibility,
           CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS rain
    FROM labelled WHERE event_type IN ('view', 'click')
),
incident_in AS (
    SELECT 'TTI-' || user_id AS t_id, category_label AS t_type,
           severity_label AS t_severity, sec AS t
    FROM labelled
    WHERE event_type IN ('error', 'purchase', 'signup')
      AND (category IS NULL OR category NOT IN (2, 4, 5, 10, 11))
),
incidents AS (
    SELECT t_id, t_type, t_severity, t FROM (
        SELECT *, row_number() OVER (
            PARTITION BY t_id, t
            ORDER BY t_type ASC NULLS LAST, t_severity ASC NULLS LAST) AS rn
        FROM incident_in)
    WHERE rn = 1
),
observations AS (
    SELECT w, weather_desc, visibility FROM (
        SELECT *, row_number() OVER (
            PARTITION BY w
            ORDER BY weather_desc ASC NULLS LAST, visibility ASC NULLS LAST,
                     rain ASC NULLS LAST) AS rn
        FROM weather_in)
    WHERE rn = 1
)"""

# Every distinct incident with its nearest observation, null labels included.
_MATCH = """,
{name} AS (
    SELECT t_id, t_type, t_severity, t, weather_desc, visibility, rain FROM (
        SELECT i.*, o.weather_desc, o.visibility, o.rain, row_number() OVER (
            PARTITION BY i.t_id, i.t
            ORDER BY abs(o.w - i.t), o.w, o.weather_desc ASC NULLS LAST,
                     o.visibility ASC NULLS LAST, o.rain ASC NULLS LAST) AS rn
        FROM incidents i JOIN weather_in o ON {condition})
    WHERE rn = 1
)"""
_MINUTE_MATCH = _MATCH.format(
    name="matched",
    condition="i.t // 60 = o.w // 60 AND i.t BETWEEN o.w - 300 AND o.w + 300",
)
_TOLERANCE_MATCH = _MATCH.format(
    name="matched", condition="i.t BETWEEN o.w - 300 AND o.w + 300"
)
_JOINED = ",\njoined AS (SELECT * FROM matched WHERE weather_desc IS NOT NULL)"

_NEAR = _EVENTS + _MINUTE_MATCH + _JOINED
_BAND = """CASE WHEN visibility < 2000 THEN 0 WHEN visibility < 5000 THEN 1
                WHEN visibility < 10000 THEN 2 ELSE 3 END"""
_BAND_LABEL = """CASE bucket_rank WHEN 0 THEN 'Poor (0-2km)'
                      WHEN 1 THEN 'Moderate (2-5km)'
                      WHEN 2 THEN 'Good (5-10km)' ELSE 'Clear (10km+)' END"""
_ROW = """t_id, t_type, t_severity, t AS t_start_epoch, weather_desc, visibility, rain"""
_FIRST_ORDER = """t ASC, t_type ASC NULLS LAST, t_severity ASC NULLS LAST,
    weather_desc ASC NULLS LAST, visibility ASC NULLS LAST, rain ASC NULLS LAST"""
_FIRST = f""",
firsts AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY {_FIRST_ORDER}) AS rn
        FROM joined)
    WHERE rn = 1
)"""

# The payload queries: some payloads are junk, some start times unreadable or
# given with an offset, some lists of conditions empty.
_PAYLOADS = """,
weather_rows AS (
    SELECT sec AS w,
           CASE WHEN event_id % 11 <> 0 THEN condition END AS weather_desc,
           metres AS visibility,
           CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS rain
    FROM labelled
    WHERE event_type IN ('view', 'click') AND event_id % 29 <> 0
),
incident_rows AS (
    SELECT 'TTI-' || user_id AS t_id, category_label AS t_type,
           severity_label AS t_severity,
           CASE event_id % 23 WHEN 0 THEN NULL WHEN 1 THEN sec - 7200 ELSE sec END AS t
    FROM labelled
    WHERE event_type IN ('error', 'purchase', 'signup') AND event_id % 29 <> 0
      AND (category IS NULL OR category NOT IN (2, 4, 5, 10, 11))
)"""
_INCIDENT_ROWS = "SELECT t_id, t_type, t_severity, t AS t_start_epoch FROM incident_rows"
_WEATHER_ROWS = """SELECT w AS w_timestamp_epoch, weather_desc, visibility, rain
FROM weather_rows"""

# A bucket is complete once the watermark has passed its end; without buckets,
# once it has passed all that a span of tolerance width can reach.
_COMPLETE = """{end} <=
    (SELECT least((SELECT max(w) FROM {w}), (SELECT max(t) FROM {t})) - 600)"""

_MINUTE_END = "t // 60 * 60 + 60"
_REACH_END = "t // 300 * 300 + 600"

_BOX = """
SELECT event_id, lat, lon FROM (
    SELECT event_id, CAST(38.0 AS DOUBLE) + value / 100 AS lat,
           CAST(-91.0 AS DOUBLE) + user_id / 100 AS lon
    FROM events)
WHERE lat BETWEEN 38.0 AND 38.5 AND lon BETWEEN -90.75 AND -90.25"""

ORACLE: dict[str, str] = {
    "normalize_weather": _EVENTS + _PAYLOADS + _WEATHER_ROWS,
    "normalize_incidents": _EVENTS + _PAYLOADS + _INCIDENT_ROWS,
    "incidents_since": _EVENTS
    + _PAYLOADS
    + _INCIDENT_ROWS
    + " WHERE t >= epoch(TIMESTAMP '2024-01-15 00:00:00')",
    "code_labels": _EVENTS
    + """
SELECT category, category_label AS t_type, magnitude, severity_label AS t_severity,
       count(*) AS n
FROM labelled WHERE poll = 1
GROUP BY ALL""",
    "bounding_box": _BOX,
    "bounding_box_cells": _BOX,
    "bounding_box_date_line": """
SELECT event_id, lat, lon FROM (
    SELECT event_id, CAST(-17.0 AS DOUBLE) + value / 100 AS lat,
           CASE WHEN east > 180 THEN east - 360 ELSE east END AS lon
    FROM (SELECT *, CAST(179.0 AS DOUBLE) + user_id % 200 / 100 AS east FROM events))
WHERE lat BETWEEN -17.25 AND -16.25
  AND (lon BETWEEN 179.25 AND 180 OR lon BETWEEN -180 AND -179.75)""",
    "payload_extras": _EVENTS
    + """,
weather AS (SELECT * FROM labelled WHERE event_type IN ('view', 'click')),
incident AS (SELECT * FROM labelled WHERE event_type IN ('error', 'purchase', 'signup')),
weather_field AS (
    SELECT CASE WHEN event_id % 29 = 0 THEN [{'path': '$', 'kind': NULL}] ELSE
        [{'path': '$.current.wind', 'kind': 'OBJECT'}]
        || CASE WHEN event_id % 11 <> 0
           THEN [{'path': '$.current.weather[*].id', 'kind': 'NUMBER'}] ELSE [] END
        || CASE WHEN event_id % 3 = 0 AND value IS NOT NULL
           THEN [{'path': '$.current.rain.3h', 'kind': 'NUMBER'}] ELSE [] END
        || CASE WHEN event_id % 5 = 0 AND value IS NOT NULL
           THEN [{'path': '$.lat', 'kind': 'NUMBER'}] ELSE [] END
        || CASE WHEN event_id % 7 = 0
           THEN [{'path': '$[''alerts.v2'']', 'kind': 'ARRAY'}] ELSE [] END
        END AS fields
    FROM weather),
incident_field AS (
    SELECT CASE WHEN event_id % 29 = 0 THEN
            CASE WHEN poll = 1 THEN [{'path': '$', 'kind': NULL}] ELSE [] END
        ELSE [{'path': '$.incidents[*].geometry', 'kind': 'OBJECT'}]
        || CASE WHEN event_id % 2 = 0 AND value IS NOT NULL
           THEN [{'path': '$.incidents[*].properties.length', 'kind': 'NUMBER'}] ELSE [] END
        || CASE WHEN event_id % 10 = 1
           THEN [{'path': '$.incidents[*].properties.probable', 'kind': 'BOOLEAN'}] ELSE [] END
        END AS fields
    FROM incident)
SELECT feed, f.path AS path, f.kind AS kind, count(*) AS n
FROM (SELECT 'weather' AS feed, unnest(fields) AS f FROM weather_field
      UNION ALL SELECT 'incidents', unnest(fields) FROM incident_field)
GROUP BY ALL""",
    "minute_bucket": """
SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute,
       count(*) FILTER (WHERE event_type IN ('view', 'click')) AS observations,
       count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS incidents
FROM events GROUP BY 1""",
    "incidents_dedup": _EVENTS
    + "\nSELECT t_id, t_type, t_severity, t AS t_start_epoch FROM incidents",
    "observations_dedup": _EVENTS
    + "\nSELECT w AS w_timestamp_epoch, weather_desc, visibility FROM observations",
    "context_join_nearest": _NEAR + f"\nSELECT {_ROW} FROM joined",
    "context_join_any_label": _EVENTS
    + _MINUTE_MATCH
    + f"\nSELECT {_ROW} FROM matched",
    "context_join_tolerance": _EVENTS
    + _TOLERANCE_MATCH
    + _JOINED
    + f"\nSELECT {_ROW} FROM joined",
    "context_join_exact_times": _EVENTS.replace(
        "CAST(floor(epoch(ts)) AS BIGINT) AS sec", "epoch_us(ts) AS sec"
    )
    + _MATCH.format(
        name="matched", condition="i.t BETWEEN o.w - 300000000 AND o.w + 300000000"
    )
    + _JOINED
    + f"\nSELECT {_ROW.replace('t_start_epoch', 't_start')} FROM joined",
    "rate_by_context": _NEAR
    + """
SELECT o.weather_desc,
       CAST(count(DISTINCT j.t_id) AS DOUBLE) / nullif(count(DISTINCT o.w), 0)
           AS incident_rate
FROM observations o LEFT JOIN joined j ON o.weather_desc = j.weather_desc
GROUP BY o.weather_desc""",
    "rate_by_bucket": _NEAR
    + f"""
SELECT {_BAND_LABEL} AS vis_range, bucket_rank,
       CAST(coalesce(n, 0) AS DOUBLE) / nullif(m, 0) AS incident_rate
FROM (SELECT {_BAND} AS bucket_rank, count(DISTINCT w) AS m
      FROM observations WHERE visibility IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT {_BAND} AS bucket_rank, count(DISTINCT t_id) AS n
           FROM joined WHERE visibility IS NOT NULL GROUP BY 1) USING (bucket_rank)""",
    "minutes_by_bucket": _EVENTS
    + f"""
SELECT {_BAND_LABEL} AS vis_range, bucket_rank, count(DISTINCT w) AS minute_count
FROM (SELECT {_BAND} AS bucket_rank, w FROM observations WHERE visibility IS NOT NULL)
GROUP BY bucket_rank""",
    "incidents_by_bucket": _NEAR
    + f"""
SELECT {_BAND_LABEL} AS vis_range, bucket_rank, count(DISTINCT t_id) AS incident_count
FROM (SELECT {_BAND} AS bucket_rank, t_id FROM joined WHERE visibility IS NOT NULL)
GROUP BY bucket_rank""",
    "severity_by_context": _NEAR
    + """
SELECT weather_desc, t_severity, count(DISTINCT t_id) AS incident_count
FROM joined WHERE t_severity IS NOT NULL
GROUP BY weather_desc, t_severity""",
    "severity_pivot": _NEAR
    + """
SELECT weather_desc,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Major') AS Major,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Minor') AS Minor,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Moderate') AS Moderate,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Undefined') AS Undefined,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Unknown') AS Unknown,
       CAST(0 AS BIGINT) AS Other
FROM joined WHERE t_severity IS NOT NULL
GROUP BY weather_desc""",
    "severity_pivot_open": _NEAR
    + """,
renamed AS (
    SELECT t_id, weather_desc,
           CASE WHEN visibility < 5000 THEN 'Low ' ELSE '' END || t_severity AS severity
    FROM joined WHERE t_severity IS NOT NULL)
SELECT weather_desc,
       count(DISTINCT t_id) FILTER (WHERE severity = 'Major') AS "Major",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Minor') AS "Minor",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Moderate') AS "Moderate",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Undefined') AS "Undefined",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Unknown') AS "Unknown",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Low Major') AS "Low Major",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Low Minor') AS "Low Minor",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Low Moderate') AS "Low Moderate",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Low Undefined') AS "Low Undefined",
       count(DISTINCT t_id) FILTER (WHERE severity = 'Low Unknown') AS "Low Unknown"
FROM renamed GROUP BY weather_desc""",
    "count_by_context": _NEAR
    + """
SELECT weather_desc, count(*) AS incident_count FROM joined GROUP BY weather_desc""",
    "count_by_context_with_null": _EVENTS
    + _MINUTE_MATCH
    + """
SELECT weather_desc, count(*) AS count FROM matched GROUP BY weather_desc""",
    "batch_row_count": _NEAR + "\nSELECT count(*) AS rows_in_batch FROM joined",
    "first_per_key": _NEAR + _FIRST + f"\nSELECT {_ROW} FROM firsts",
    "first_per_key_history": _NEAR
    + _FIRST
    + f"\nSELECT {_ROW} FROM firsts ORDER BY t DESC, t_id LIMIT 1000",
    "first_incident_per_key": _EVENTS
    + """
SELECT t_id, t_type, t_severity, t AS t_start_epoch FROM (
    SELECT *, row_number() OVER (
        PARTITION BY t_id
        ORDER BY t, t_type ASC NULLS LAST, t_severity ASC NULLS LAST) AS rn
    FROM incident_in)
WHERE rn = 1""",
    "latest_snapshot": _NEAR
    + f"\nSELECT {_ROW} FROM joined ORDER BY t DESC, t_id LIMIT 100",
    "newest_first": _NEAR + f"\nSELECT {_ROW} FROM joined ORDER BY t DESC, t_id",
    "sql_over_tables": _NEAR
    + """
SELECT weather_desc, instants, coalesce(incidents, 0) AS incidents
FROM (SELECT weather_desc, count(*) AS instants FROM observations GROUP BY 1)
LEFT JOIN (SELECT weather_desc, count(DISTINCT t_id) AS incidents
           FROM joined GROUP BY 1) USING (weather_desc)""",
    "sql_history": _NEAR
    + """
SELECT t_id, min(t) AS first_start, count(*) AS starts,
       count(DISTINCT weather_desc) AS conditions
FROM joined GROUP BY t_id""",
    "sql_rate_by_bucket": _NEAR
    + f"""
SELECT {_BAND_LABEL} AS vis_range, CAST(coalesce(n, 0) AS DOUBLE) / nullif(m, 0) AS incident_rate
FROM (SELECT {_BAND} AS bucket_rank, count(DISTINCT w) AS m
      FROM observations WHERE visibility IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT {_BAND} AS bucket_rank, count(DISTINCT t_id) AS n
           FROM joined WHERE visibility IS NOT NULL GROUP BY 1) USING (bucket_rank)""",
    "severity_pivot_incremental": _NEAR
    + """
SELECT weather_desc,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Major') AS Major,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Minor') AS Minor,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Moderate') AS Moderate,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Undefined') AS Undefined,
       count(DISTINCT t_id) FILTER (WHERE t_severity = 'Unknown') AS Unknown
FROM joined WHERE t_severity IS NOT NULL
GROUP BY weather_desc""",
    "history_limited": _NEAR
    + _FIRST
    + f"\nSELECT {_ROW} FROM firsts ORDER BY t DESC, t_id LIMIT 30",
    "joined_by_ids": _NEAR
    + f"""
SELECT {_ROW} FROM joined
WHERE t_id IN (SELECT t_id FROM joined ORDER BY t DESC, t_id LIMIT 100)""",
    "live_snapshot_recent": _NEAR
    + f"\nSELECT {_ROW} FROM joined ORDER BY t DESC, t_id LIMIT 100",
    "live_snapshot_counts": _NEAR
    + "\nSELECT weather_desc, count(*) AS count FROM joined GROUP BY weather_desc",
    "topic_roundtrip": _EVENTS + _PAYLOADS + _INCIDENT_ROWS,
    "topic_roundtrip_weather": _EVENTS + _PAYLOADS + _WEATHER_ROWS,
    "stream_publish": _EVENTS
    + _PAYLOADS
    + _INCIDENT_ROWS
    + "\nUNION ALL BY NAME\n"
    + _WEATHER_ROWS,
    "publish_rejects": _EVENTS
    + """
SELECT 'weather' AS feed, count(*) AS payloads,
       count(*) FILTER (WHERE event_id % 29 = 0) AS rejects
FROM labelled WHERE event_type IN ('view', 'click')
UNION ALL
SELECT 'incidents', count(*), count(*) FILTER (WHERE event_id % 29 = 0)
FROM labelled WHERE event_type IN ('error', 'purchase', 'signup') AND poll = 1""",
    "ingestion_stamp": _EVENTS
    + _PAYLOADS
    + """
SELECT 'weather' AS feed, TRUE AS well_formed, count(*) AS records FROM weather_rows
UNION ALL
SELECT 'incidents', TRUE, count(*) FROM incident_rows""",
    "stream_dedup": _EVENTS
    + "\nSELECT t_id, t AS t_start_epoch, TRUE AS known FROM incidents",
    "stream_dedup_observations": _EVENTS
    + "\nSELECT w AS w_timestamp_epoch, TRUE AS known FROM observations",
    "stream_context_join_nearest": _NEAR
    + f"\nSELECT {_ROW} FROM joined WHERE "
    + _COMPLETE.format(end=_MINUTE_END, w="weather_in", t="incident_in"),
    "stream_context_join_tolerance": _EVENTS
    + _TOLERANCE_MATCH
    + _JOINED
    + f"\nSELECT {_ROW} FROM joined WHERE "
    + _COMPLETE.format(end=_REACH_END, w="weather_in", t="incident_in"),
    "stream_drained_tolerance": _EVENTS
    + _TOLERANCE_MATCH
    + _JOINED
    + f"\nSELECT {_ROW} FROM joined",
    "stream_replayed_from_zero": _EVENTS
    + "\nSELECT t_id, t AS t_start_epoch, TRUE AS known FROM incidents",
    "stream_context_join_exact_times": _EVENTS.replace(
        "CAST(floor(epoch(ts)) AS BIGINT) AS sec", "epoch_us(ts) AS sec"
    )
    + _MATCH.format(
        name="matched", condition="i.t BETWEEN o.w - 300000000 AND o.w + 300000000"
    )
    + _JOINED
    + f"\nSELECT {_ROW.replace('t_start_epoch', 't_start')} FROM joined WHERE "
    + """t // 300000000 * 300000000 + 600000000 <=
    (SELECT least((SELECT max(w) FROM weather_in), (SELECT max(t) FROM incident_in))
     - 600000000)""",
    "stream_context_join_first": _EVENTS
    + _MINUTE_MATCH
    + """
SELECT t_id, t AS t_start_epoch, TRUE AS incident_known, TRUE AS context_known
FROM matched""",
    "stream_late_rows": _EVENTS
    + """
SELECT count(*) AS late_rows FROM incident_in
WHERE t <= (SELECT max(t) FROM incident_in) - 600""",
    "late_rows_replayed": _EVENTS
    + _PAYLOADS
    + """
SELECT DISTINCT t_id, t AS t_start_epoch, TRUE AS known FROM incident_rows WHERE t IS NOT NULL""",
    "quarantined": _EVENTS
    + """,
message AS (
    SELECT event_id > (SELECT max(event_id) // 2 FROM events) AS newer,
           CASE event_id % 23 WHEN 0 THEN NULL WHEN 1 THEN sec - 7200 ELSE sec END AS t
    FROM labelled
    WHERE event_type IN ('error', 'purchase', 'signup') AND event_id % 29 <> 0
      AND (category IS NULL OR category NOT IN (2, 4, 5, 10, 11))),
parted AS (
    SELECT CASE WHEN t IS NULL THEN 'without_time'
        WHEN NOT newer AND t <= (SELECT max(t) FROM message WHERE newer) - 600 THEN 'late'
        ELSE 'passed' END AS reason
    FROM message
    UNION ALL
    SELECT 'unreadable' FROM labelled
    WHERE event_type IN ('error', 'purchase', 'signup') AND event_id % 29 = 0 AND poll = 1)
SELECT reason, count(*) AS n FROM parted GROUP BY reason
UNION ALL SELECT 'late behind the gate', 0""",
    "pipeline_epochs": _EVENTS
    + """
SELECT CAST(2 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS epochs, count(*) AS rows
FROM incident_in""",
    "pipeline_first": _EVENTS
    + _PAYLOADS
    + """,
minutes AS (
    SELECT w // 60 AS minute, bool_or(weather_desc IS NULL) AS open
    FROM weather_rows GROUP BY 1)
SELECT 'joined' AS part, t_id, t AS t_start_epoch, TRUE AS incident_known,
       TRUE AS context_known, CAST(NULL AS BIGINT) AS w_timestamp_epoch,
       CAST(NULL AS BIGINT) AS wrong
FROM (SELECT DISTINCT t_id, t FROM incident_rows WHERE t IS NOT NULL)
JOIN minutes ON t // 60 = minute WHERE NOT open
UNION ALL
SELECT DISTINCT 'observations', NULL, NULL, NULL, TRUE, w, NULL FROM weather_rows
UNION ALL SELECT 'joined_not_delivered', NULL, NULL, NULL, NULL, NULL, 0
UNION ALL SELECT 'snapshot_not_joined', NULL, NULL, NULL, NULL, NULL, 0""",
    "pipeline_tables": _EVENTS
    + _PAYLOADS
    + f""",
incidents_once AS (
    SELECT t_id, t_type, t_severity, t FROM (
        SELECT *, row_number() OVER (
            PARTITION BY t_id, t
            ORDER BY t_type ASC NULLS LAST, t_severity ASC NULLS LAST) AS rn
        FROM incident_rows WHERE t IS NOT NULL)
    WHERE rn = 1
),
pairs AS (
    SELECT i.*, o.weather_desc, o.visibility, o.rain, row_number() OVER (
        PARTITION BY i.t_id, i.t
        ORDER BY abs(o.w - i.t), o.w, o.weather_desc ASC NULLS LAST,
                 o.visibility ASC NULLS LAST, o.rain ASC NULLS LAST) AS rn
    FROM incidents_once i JOIN weather_rows o ON i.t // 60 = o.w // 60
),
kept AS (
    SELECT {_ROW} FROM pairs WHERE rn = 1 AND weather_desc IS NOT NULL
    AND {_COMPLETE.format(end=_MINUTE_END, w='weather_rows', t='incident_rows')}
)
SELECT 'joined' AS part, * FROM kept
UNION ALL BY NAME
SELECT DISTINCT 'observations' AS part, w AS w_timestamp_epoch, TRUE AS known
FROM weather_rows
UNION ALL BY NAME
SELECT 'snapshot' AS part, weather_desc, count(*) AS count FROM kept GROUP BY weather_desc""",
}
# The same rows, worked out epoch by epoch.
ORACLE["rate_incremental"] = ORACLE["rate_by_context"]
ORACLE["rate_by_bucket_incremental"] = ORACLE["rate_by_bucket"]
