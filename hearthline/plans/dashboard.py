"""Dashboard queries: several tiers, fill, latest values, texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hearthline.constants import PLACEHOLDER, SENSORS, STALE_HUB_S
from hearthline.functions import scalar as S
from hearthline.operators import health
from hearthline.operators.dashboard import dashboard, whole_days
from hearthline.operators.normalize import plausible
from hearthline.plans.registry import query
from hearthline.plans.rollups import DIGITS, rounded
from hearthline.plans.views import Views
from hearthline.sources import dims

TIERS = ("autogen", "two_month", "one_year", "forever")


def _dashboard(v: Views, agg: str, width_s: int, how: str):
    return dashboard(v.points, agg, TIERS, *whole_days(v.points), width_s, how)


def _bucket_sql(aggregate: str, width: str) -> str:
    return (
        f"SELECT measurement, field, time_bucket(INTERVAL '{width}', time) AS time, {aggregate} AS value "
        "FROM {points} GROUP BY ALL"
    )


def _last_sql(width: str) -> str:
    return (
        "SELECT measurement, field, bucket AS time, value FROM (SELECT *, "
        f"time_bucket(INTERVAL '{width}', time) AS bucket, row_number() OVER (PARTITION BY measurement, field, "
        f"time_bucket(INTERVAL '{width}', time) ORDER BY time DESC, write_seq DESC) AS rn FROM {{points}}) WHERE rn = 1"
    )


def _spine_sql(buckets: str, width: str) -> str:
    """Every bucket of every series, with the non-empty bucket at, before and after it."""
    return f"""
    WITH b AS ({buckets}),
    edges AS (SELECT measurement, field, time, min(value) AS lo, max(value) AS hi FROM b GROUP BY ALL),
    spine AS (SELECT s.measurement, s.field, unnest(generate_series(
                  (SELECT date_trunc('day', min(ts)) FROM events),
                  (SELECT date_trunc('day', max(ts)) FROM events) + INTERVAL '1 day' - INTERVAL '{width}',
                  INTERVAL '{width}')) AS time
              FROM (SELECT DISTINCT measurement, field FROM b) s),
    linked AS (SELECT s.*, e.time AS t_at,
                   last_value(e.time IGNORE NULLS) OVER before AS t_before,
                   last_value(e.hi IGNORE NULLS) OVER before AS v_before,
                   first_value(e.time IGNORE NULLS) OVER after AS t_after,
                   first_value(e.lo IGNORE NULLS) OVER after AS v_after
               FROM spine s LEFT JOIN edges e USING (measurement, field, time)
               WINDOW before AS (PARTITION BY s.measurement, s.field ORDER BY s.time ROWS UNBOUNDED PRECEDING),
                      after AS (PARTITION BY s.measurement, s.field ORDER BY s.time
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    """


_LINEAR = """
    SELECT measurement, field, time, value FROM b
    UNION ALL
    SELECT measurement, field, time,
           v_before + (v_after - v_before) * ((epoch_us(time) - epoch_us(t_before))
                 / CAST(epoch_us(t_after) - epoch_us(t_before) AS DOUBLE)) AS value
    FROM linked WHERE t_at IS NULL
"""
_NULL = f"""
    SELECT measurement, field, time, round(value, {DIGITS}) AS value FROM b
    UNION ALL SELECT measurement, field, time, NULL AS value FROM linked WHERE t_at IS NULL
"""


@query("dash_last_fill_none", _last_sql("1 minute"))
def dash_last_fill_none(v: Views):
    return _dashboard(v, "last", 60, "none")


@query("dash_fill_linear", _spine_sql(_last_sql("1 hour"), "1 hour") + _LINEAR)
def dash_fill_linear(v: Views):
    return _dashboard(v, "last", 3600, "linear")


@query(
    "dash_distinct_fill_linear",
    _spine_sql(
        "SELECT DISTINCT measurement, field, time_bucket(INTERVAL '30 minutes', time) AS time, value FROM {points}",
        "30 minutes",
    )
    + _LINEAR,
)
def dash_distinct_fill_linear(v: Views):
    return _dashboard(v, "distinct", 1800, "linear")


@query("dash_fill_null", _spine_sql(_bucket_sql("avg(value)", "1 hour"), "1 hour") + _NULL)
def dash_fill_null(v: Views):
    return rounded(_dashboard(v, "mean", 3600, "null"))


@query(
    "latest_board",
    """
    SELECT measurement, field, value, time FROM (
        SELECT *, row_number() OVER (PARTITION BY measurement, field ORDER BY time DESC, write_seq DESC) AS rn
        FROM {points}) WHERE rn = 1
    """,
)
def latest_board(v: Views):
    return health.latest_board(v.points)


# The checks print from integers, without floating point.
_TEMP_TEXT = (
    "CASE WHEN iTempA IS NULL THEN '----------' ELSE (CASE WHEN iTempA < 0 THEN '-' ELSE '' END) "
    "|| CAST(abs(iTempA) // 100 AS STRING) || '.' || lpad(CAST(abs(iTempA) % 100 AS STRING), 2, '0') || ' °C' END"
)


def _truncated_text(column: str, unit: str) -> str:
    tenths = f"({column} // 10)"
    return (
        f"CASE WHEN {column} IS NULL THEN '----------' ELSE CAST({tenths} // 10 AS STRING) || '.' || "
        f"CAST({tenths} % 10 AS STRING) || ' {unit}' END"
    )


@query(
    "display_text",
    f"SELECT seq, {_TEMP_TEXT} AS temp_text, {_truncated_text('iHumi', ' %')} AS humi_text, "
    f"{_truncated_text('iAtmo', 'hPA')} AS atmo_text FROM {{readings}}",
)
def display_text(v: Views):
    return v.readings.select(
        "seq",
        S.temperature_text(F.col("iTempA")).alias("temp_text"),
        S.humidity_text(F.col("iHumi")).alias("humi_text"),
        S.pressure_text(F.col("iAtmo")).alias("atmo_text"),
    )


_SENSOR_VALUES = ", ".join(f"({c}, {'NULL' if label is None else repr(label)})" for c, *_, label in SENSORS)


@query(
    "display_board",
    f"""
    WITH valid AS (SELECT seq, ts, channel,
                          CASE WHEN iTempA > -4000 AND iTempA < 4000 THEN iTempA END AS iTempA FROM {{readings}}),
    seen AS (SELECT channel, max(ts) AS last_seen FROM valid GROUP BY channel),
    temp AS (SELECT channel, iTempA FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, seq DESC)
             AS rn FROM valid WHERE iTempA IS NOT NULL) WHERE rn = 1),
    board AS (SELECT s.channel, d.label, epoch_us((SELECT max(ts) FROM events)) - epoch_us(s.last_seen) AS age_us,
                     CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(s.last_seen) > 7200000000
                          THEN NULL ELSE t.iTempA END AS iTempA
              FROM seen s LEFT JOIN temp t USING (channel)
              LEFT JOIN (VALUES {_SENSOR_VALUES}) d(channel, label) ON s.channel = d.channel)
    SELECT channel, label, {_TEMP_TEXT} AS temp_text, CAST(age_us // 60000000 AS STRING) || ':'
           || lpad(CAST(age_us // 1000000 % 60 AS STRING), 2, '0') AS age_text
    FROM board
    """,
)
def display_board(v: Views):
    """The display: one line per sensor heard, the value hidden once it is stale (here after two hours)."""
    readings = plausible(v.readings)
    as_of = v.events.agg(F.max("ts")).scalar()
    state = health.latest_state(readings).join(dims.sensors(v.spark).select("channel", "label"), "channel", "left")
    age = health.seconds_between(F.col("last_seen"), as_of)
    shown = F.when(age <= 30 * STALE_HUB_S, S.temperature_text(F.col("iTempA"))).otherwise(F.lit(PLACEHOLDER))
    return state.select("channel", "label", shown.alias("temp_text"), S.age_text(age).alias("age_text"))


@query(
    "fmt_payload",
    """
    SELECT event_id, CAST(CAST(value AS DECIMAL(12, 2)) AS STRING) || '0' AS three,
           CAST(CAST(value AS DECIMAL(12, 2)) AS STRING) AS two,
           CAST(CAST(floor(value + 0.5) AS BIGINT) AS STRING) AS whole
    FROM events
    """,
)
def fmt_payload(v: Views):
    value = F.col("value")
    return v.events.select(
        "event_id",
        S.fixed_decimals(value, 4, 3).alias("three"),
        S.fixed_decimals(value, 3, 2).alias("two"),
        S.fixed_decimals(value, 1, 0).alias("whole"),
    )


@query(
    "mac_text",
    """
    SELECT event_id, substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2)
           || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) AS mac
    FROM (SELECT event_id, printf('%012X', event_id * 7919 + user_id) AS h FROM events)
    """,
)
def mac_text(v: Views):
    mac = F.expr("unhex(lpad(hex(event_id * 7919 + user_id), 12, '0'))")
    return v.events.select("event_id", S.mac_text(mac).alias("mac"))


@query(
    "time_text",
    "SELECT event_id, strftime(ts, '%a  %d-%m-%y %H:%M:%S') AS date_text, strftime(ts, '%H:%M') AS clock_text FROM events",
)
def time_text(v: Views):
    return v.events.select(
        "event_id", S.date_text(F.col("ts")).alias("date_text"), S.clock_text(F.col("ts")).alias("clock_text")
    )


@query(
    "local_time",
    """
    WITH spread AS (SELECT event_id, ts + (event_id % 1000) * INTERVAL '1 day' AS utc FROM events),
    years AS (SELECT *, make_timestamp(year(utc), 3, 31, 1, 0, 0) AS mar, make_timestamp(year(utc), 10, 31, 1, 0, 0) AS oct
              FROM spread)
    SELECT event_id, utc, utc + CASE WHEN utc >= mar - dayofweek(mar) * INTERVAL '1 day'
                                      AND utc < oct - dayofweek(oct) * INTERVAL '1 day'
                                     THEN INTERVAL '2 hours' ELSE INTERVAL '1 hour' END AS local
    FROM years
    """,
)
def local_time(v: Views):
    utc = F.expr("ts + make_dt_interval(CAST(event_id % 1000 AS INT))")
    return v.events.select("event_id", utc.alias("utc"), S.local_time(utc).alias("local"))


@query(
    "capability_text",
    "SELECT seq, "
    + " || ' ' || ".join(
        f"'{name}: ' || CASE WHEN (caps & {bit}) <> 0 THEN '1' ELSE '0' END"
        for name, bit in (
            ("TempA", 1),
            ("Humi", 8),
            ("Volt", 4),
            ("Atmo", 32),
            ("TempB", 2),
            ("Light", 16),
            ("RGB", 64),
            ("Opt2", 128),
            ("Opt3", 256),
        )
    )
    + " AS capabilities FROM {readings}",
)
def capability_text(v: Views):
    return v.readings.select("seq", S.capability_text(F.col("caps")).alias("capabilities"))


@query("valve_mode", "SELECT event_id, CASE WHEN event_id % 7 < 6 THEN 'MAN' ELSE 'AUTO' END AS mode FROM events")
def valve_mode(v: Views):
    return v.events.select("event_id", S.mode_label(F.col("event_id") % 7).alias("mode"))


@query(
    "dash_cut_range",
    """
    WITH found AS (SELECT * FROM {points}
                   WHERE tier IN ('two_month', 'one_year') AND measurement = 'sSens1' AND field IN ('fTempA', 'fHumi')
                     AND time >= TIMESTAMP '2024-01-05 22:10:00' AND time < TIMESTAMP '2024-01-09 09:35:00'),
    b AS (SELECT measurement, field, time_bucket(INTERVAL '1 hour', time) AS time, avg(value) AS value FROM found GROUP BY ALL),
    spine AS (SELECT s.measurement, s.field, unnest(generate_series(TIMESTAMP '2024-01-05 22:00:00',
                  TIMESTAMP '2024-01-09 09:00:00', INTERVAL '1 hour')) AS time
              FROM (SELECT DISTINCT measurement, field FROM b) s)
    SELECT measurement, field, time, round(value, """
    + str(DIGITS)
    + """) AS value
    FROM spine LEFT JOIN b USING (measurement, field, time)
    """,
)
def dash_cut_range(v: Views):
    """A range that cuts its first and last bucket, one measurement, two fields, some tiers."""
    t0, t1 = datetime(2024, 1, 5, 22, 10), datetime(2024, 1, 9, 9, 35)
    return rounded(dashboard(v.points, "mean", ("two_month", "one_year"), t0, t1, 3600, "null", "sSens1", ["fTempA", "fHumi"]))
