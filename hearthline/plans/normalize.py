"""Validation, units and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.constants import CAPABILITY_BITS, LIMITS, SENSORS
from hearthline.functions import scalar as S
from hearthline.operators import normalize as N
from hearthline.operators.ingest import parse_frames, split_frames
from hearthline.plans.registry import query
from hearthline.plans.views import Views
from hearthline.sources import dims


@query(
    "channel_filter",
    "SELECT *, channel BETWEEN 1 AND 9 AS accepted_by_hub, channel BETWEEN 0 AND 6 AS accepted_by_bridge, "
    "channel BETWEEN 0 AND 5 AS accepted_by_legacy FROM (SELECT seq, channel FROM {readings})",
)
def channel_filter(v: Views):
    rows = v.readings.select("seq", "channel")
    for name, lo, hi in (("hub", 1, 9), ("bridge", 0, 6), ("legacy", 0, 5)):
        rows = N.with_channel_check(rows, lo, hi).withColumnRenamed("accepted", f"accepted_by_{name}")
    return rows


def _plausible_sql(field: str) -> str:
    lo, inclusive, hi = LIMITS[field]
    return f"CASE WHEN {field} {'>=' if inclusive else '>'} {lo} AND {field} < {hi} THEN {field} END AS {field}"


@query(
    "plausible", "SELECT seq, channel, caps, " + ", ".join(_plausible_sql(f) for f in LIMITS) + " FROM {readings}"
)
def plausible(v: Views):
    return N.plausible(v.readings).select("seq", "channel", "caps", *LIMITS)


@query(
    "sentinel_null",
    """
    SELECT seq, CASE WHEN temp_a NOT IN (999999, -99, -127) THEN temp_a END AS temp_a,
           CASE WHEN temp_b NOT IN (999999, -99, -127) THEN temp_b END AS temp_b,
           CASE WHEN humi NOT IN (999999, -99, -1) AND NOT isnan(humi) THEN humi END AS humi,
           CASE WHEN volt NOT IN (999999, -99, -1) THEN volt END AS volt,
           CASE WHEN "nLux" NOT IN (999999, -99) THEN "nLux" END AS "nLux"
    FROM {radio}
    """,
)
def sentinel_null(v: Views):
    return N.null_sentinels(v.radio).select("seq", "temp_a", "temp_b", "humi", "volt", "nLux")


@query(
    "checksum_ok",
    """
    WITH parsed AS (
        SELECT seq, json_extract_string(regexp_extract(text, '%([^$]*)\\$', 1), '$.' || k) AS x, k
        FROM {frames}, (VALUES ('sensor'), ('SensCap'), ('iTempA'), ('iTempB'), ('iHumi'), ('iVolt'), ('iLight'),
                               ('iAtmo'), ('iCSum')) keys(k)
        WHERE regexp_matches(text, '%([^$]*)\\$') AND json_valid(regexp_extract(text, '%([^$]*)\\$', 1)))
    SELECT seq, CAST(max(CAST(x AS INT)) FILTER (WHERE k = 'sensor') AS INT) AS sensor,
           CAST(max(CAST(x AS INT)) FILTER (WHERE k = 'iCSum') AS INT) AS received,
           CAST(sum(CAST(x AS INT)) FILTER (WHERE k NOT IN ('sensor', 'iCSum')) AS INT) AS checksum,
           max(CAST(x AS INT)) FILTER (WHERE k = 'iCSum')
             = sum(CAST(x AS INT)) FILTER (WHERE k NOT IN ('sensor', 'iCSum')) AS checksum_ok
    FROM parsed GROUP BY seq
    """,
)
def checksum_ok(v: Views):
    frames = parse_frames(split_frames(v.frames)).where(~F.col("bad_json"))
    summed = N.with_checksum(frames)
    return summed.select("seq", "sensor", F.col("iCSum").alias("received"), "checksum", "checksum_ok")


@query(
    "capability_flags",
    "SELECT seq, caps, "
    + ", ".join(f'(caps & {bit}) <> 0 AS "has_{name}"' for name, bit in CAPABILITY_BITS.items())
    + " FROM {readings}",
)
def capability_flags(v: Views):
    return N.capability_flags(v.readings.select("seq", "caps"))


_REGISTRY = ", ".join(
    f"({channel}, {caps}, CAST({batt} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), "
    f"{'NULL' if label is None else repr(label)})"
    for channel, caps, batt, a, b, label in SENSORS
)
REGISTRY_SQL = f"(VALUES {_REGISTRY}) s(channel, static_caps, batt_corr, temp_a_corr, temp_b_corr, label)"


@query(
    "calibrate",
    f"""
    WITH clean AS (
        SELECT seq, channel, CASE WHEN temp_a NOT IN (-99, -127) THEN temp_a END AS temp_a,
               CASE WHEN temp_b <> -127 THEN temp_b END AS temp_b, CASE WHEN volt <> -1 THEN volt END AS volt,
               CASE WHEN humi NOT IN (999999, -1) AND NOT isnan(humi) THEN humi END AS humi
        FROM {{radio}})
    SELECT seq, c.channel, CAST(round((temp_a + temp_a_corr) * CAST(100 AS DOUBLE)) AS INT) AS "iTempA",
           CAST(round((temp_b + temp_b_corr) * CAST(100 AS DOUBLE)) AS INT) AS "iTempB",
           CAST(round((volt + batt_corr) * CAST(100 AS DOUBLE)) AS INT) AS "iVolt",
           CAST(round(humi * CAST(100 AS DOUBLE)) AS INT) AS "iHumi"
    FROM clean c LEFT JOIN {REGISTRY_SQL} ON c.channel = s.channel
    """,
)
def calibrate(v: Views):
    calibrated = N.calibrate(N.null_sentinels(v.radio), dims.sensors(v.spark))
    return calibrated.select("seq", "channel", "iTempA", "iTempB", "iVolt", "iHumi")


@query(
    "capability_lookup",
    f"""
    SELECT seq, r.channel, coalesce(r.caps, s.static_caps) AS effective_caps
    FROM {{radio}} r LEFT JOIN {REGISTRY_SQL} ON r.channel = s.channel
    """,
)
def capability_lookup(v: Views):
    return N.effective_capabilities(v.radio, dims.sensors(v.spark)).select("seq", "channel", "effective_caps")


@query(
    "label_lookup",
    f"SELECT seq, r.channel, s.label FROM {{readings}} r LEFT JOIN {REGISTRY_SQL} ON r.channel = s.channel",
)
def label_lookup(v: Views):
    return N.with_sensor(v.readings.select("seq", "channel"), dims.sensors(v.spark)).select("seq", "channel", "label")


_RAW_SQL = "CAST(floor(value * 100) AS INT)"


def _raw():
    return F.expr(_RAW_SQL)


@query(
    "adc_to_volt",
    f"SELECT event_id, ({_RAW_SQL} % 1024) * CAST(0.01076923073 AS DOUBLE) AS volt FROM events",
)
def adc_to_volt(v: Views):
    return v.events.select("event_id", S.adc_to_volt(_raw() % 1024).alias("volt"))


@query(
    "pressure_norm",
    f"SELECT event_id, 78000 + {_RAW_SQL} % 45000 + 3400 AS sea_level_pa, "
    f"(78000 + {_RAW_SQL} % 45000) / CAST(100 AS DOUBLE) AS hpa FROM events",
)
def pressure_norm(v: Views):
    pascal = _raw() % 45000 + 78000
    return v.events.select(
        "event_id", S.sea_level_pressure(pascal).alias("sea_level_pa"), S.hectopascal(pascal).alias("hpa")
    )


@query(
    "light_norm",
    f"""
    SELECT event_id, count * 100 AS scaled, CAST(trunc(count / CAST(1.2 AS DOUBLE)) AS INT) AS legacy
    FROM (SELECT event_id, CAST(({_RAW_SQL} % 256) * 256 + event_id % 256 AS INT) AS count FROM events)
    """,
)
def light_norm(v: Views):
    count = S.light_count(_raw() % 256, F.col("event_id") % 256)
    return v.events.select("event_id", S.light_scaled(count).alias("scaled"), S.light_legacy(count).alias("legacy"))


@query(
    "load_voltage",
    f"SELECT event_id, value + ({_RAW_SQL} % 320) / CAST(1000 AS DOUBLE) AS load_v FROM events",
)
def load_voltage(v: Views):
    return v.events.select("event_id", S.load_voltage(F.col("value"), _raw() % 320).alias("load_v"))


@query("linear_map", "SELECT event_id, CAST((event_id % 6) * 4095 // 5 AS INT) AS dac FROM events")
def linear_map(v: Views):
    return v.events.select("event_id", S.dac_value(F.col("event_id") % 6).alias("dac"))


@query("trunc_int", "SELECT event_id, CAST(trunc(value - 250) AS INT) AS sent FROM events")
def trunc_int(v: Views):
    return v.events.select("event_id", S.truncated(F.col("value") - 250).alias("sent"))
