"""Telemetry tables derived from the given ones.

Each view is a SELECT list that both Spark SQL and the checking SQL engine evaluate, so both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.session import configure
from hearthline.sources.tables import event_time, read_table, stream_table

_MEASUREMENT = "CASE WHEN {n} = 0 THEN 'SensorLoc' ELSE 'sSens' || CAST({n} AS STRING) END"
_V = "CAST(floor(value * 100) AS INT)"
_CAPS = "CAST(event_id % 64 AS INT)"


def _gated(bit: int, expr: str) -> str:
    return f"CASE WHEN ((event_id % 64) & {bit}) <> 0 THEN CAST({expr} AS INT) END"


POINTS = {
    "tier": "CASE event_id % 4 WHEN 0 THEN 'autogen' WHEN 1 THEN 'two_month' WHEN 2 THEN 'one_year' "
    "ELSE 'forever' END",
    "measurement": _MEASUREMENT.format(n="user_id % 10"),
    "time": "ts",
    "field": "CASE event_type WHEN 'click' THEN 'fTempA' WHEN 'view' THEN 'fHumi' WHEN 'purchase' THEN 'fVolt' "
    "WHEN 'signup' THEN 'iLight' ELSE 'Err' END",
    "value": "CAST(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END "
    "ELSE value END AS DOUBLE)",
    "write_seq": "event_id",
}

# Points with a tag beside the measurement.
TAGGED_POINTS = {**POINTS, "node": "user_id"}

# Points in every tier, measurement and field that a rollup definition reads.
SPEC_POINTS = {
    "tier": "CASE event_id % 5 WHEN 0 THEN 'autogen' WHEN 1 THEN 'two_month' WHEN 2 THEN 'one_year' "
    "WHEN 3 THEN 'two_years' ELSE 'half_year' END",
    "measurement": "CASE user_id % 10 WHEN 0 THEN 'SensorLoc' WHEN 9 THEN 'ValveControl' "
    "ELSE 'sSens' || CAST(user_id % 10 AS STRING) END",
    "time": "ts",
    "field": "CASE event_type WHEN 'click' THEN CASE user_id % 10 WHEN 9 THEN 'TempIn' ELSE 'fTempA' END "
    "WHEN 'view' THEN CASE user_id % 10 WHEN 9 THEN 'TempOut' ELSE 'fHumi' END "
    "WHEN 'purchase' THEN 'fVolt' WHEN 'signup' THEN 'iLight' ELSE 'fAtmo' END",
    "value": "CAST(value AS DOUBLE)",
    "write_seq": "event_id",
}

POINTS_LONG = {
    "tier": "CASE l_linenumber % 4 WHEN 0 THEN 'autogen' WHEN 1 THEN 'two_month' WHEN 2 THEN 'one_year' "
    "ELSE 'two_years' END",
    "measurement": _MEASUREMENT.format(n="l_suppkey % 10"),
    "time": "l_shipdate",
    "field": "'f' || l_returnflag",
    "value": "l_extendedprice",
}

READINGS = {
    "seq": "event_id",
    "ts": "ts",
    "channel": "CAST(user_id % 10 AS INT)",
    "caps": _CAPS,
    "iTempA": _gated(1, f"{_V} % 9000 - 4500"),
    "iTempB": _gated(2, f"({_V} * 7) % 9000 - 4500"),
    "iHumi": _gated(8, f"{_V} % 11000"),
    "iVolt": _gated(4, f"{_V} % 600"),
    "iLight": _gated(16, f"({_V} * 31) % 1000000"),
    "iAtmo": _gated(32, f"78000 + {_V} % 45000"),
}

# The same values before any capability gate.
RAW_READINGS = {
    "seq": "event_id",
    "ts": "ts",
    "channel": "CAST(user_id % 10 AS INT)",
    "caps": _CAPS,
    "iTempA": f"CAST({_V} % 9000 - 4500 AS INT)",
    "iTempB": f"CAST(({_V} * 7) % 9000 - 4500 AS INT)",
    "iHumi": f"CAST({_V} % 11000 AS INT)",
    "iVolt": f"CAST({_V} % 600 AS INT)",
}

# Readings of the older schema, in floats.
LEGACY_READINGS = {
    "seq": "event_id",
    "ts": "ts",
    "channel": "CAST(user_id % 7 AS INT)",
    "fTempA": "CAST((floor(value * 100) - 25000) / 100.0 AS DOUBLE)",
    "fHumi": "CAST(floor(value * 25) / 100.0 AS DOUBLE)",
    "fVolt": "CAST(CASE WHEN event_id % 11 <> 0 THEN (200 + event_id % 150) / 100.0 END AS DOUBLE)",
    "iLight": "CAST(floor(value * 10) AS INT)",
    "fAtmo": "CAST((90000 + floor(value * 25)) / 100.0 AS DOUBLE)",
}

# The keys of a uniform frame as text; a key whose value is NULL is left out.
_JSON_PARTS = " || ".join(
    f"coalesce(',\"{f}\":' || CAST({f} AS STRING), '')"
    for f in ("iTempA", "iTempB", "iHumi", "iVolt", "iLight", "iAtmo")
)
_SUM = " + ".join(["caps"] + [f"coalesce({f}, 0)" for f in ("iTempA", "iTempB", "iHumi", "iVolt", "iLight", "iAtmo")])

# Frames over READINGS: noise in front, and some with a wrong sum, no closing brace, or no end marker.
FRAMES = {
    "seq": "seq",
    "ts": "ts",
    "channel": "channel",
    "text": "'xx%{\"sensor\":' || CAST(channel AS STRING) || ',\"time\":' || CAST(seq AS STRING) || ',\"SensCap\":' "
    f"|| CAST(caps AS STRING) || {_JSON_PARTS} || ',\"iCSum\":' "
    f"|| CAST({_SUM} + CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END AS STRING) "
    "|| CASE WHEN seq % 23 = 0 THEN '' ELSE '}' END || CASE WHEN seq % 29 = 0 THEN '' ELSE '$' END",
}


# The same text as a serial port delivers it, each frame cut somewhere in two rows.
FRAME_PARTS = {
    "port": "channel",
    "ts": "ts",
    "seq": "2 * seq + half",
    "text": "CASE WHEN half = 0 THEN substr(text, 1, CAST(3 + seq % 40 AS INT)) "
    "ELSE substr(text, CAST(4 + seq % 40 AS INT)) END",
}


def _two_decimals(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(12, 2)) AS STRING)"


def _legacy(sensor: int, keys: list[tuple[str, str]]) -> str:
    body = " || ".join(f"',\"{key}\":' || {_two_decimals(expr)}" for key, expr in keys)
    return f"WHEN {sensor} THEN {body}"


_TEMP, _HUMI, _LIGHT, _ATMO = "value - 250", "floor(value * 25) / 100.0", "floor(value * 10)", "900 + floor(value * 25) / 100.0"
# Every eleventh frame lacks its voltage.
LEGACY_FRAMES = {
    "seq": "event_id",
    "payload": "'{\"sensor\":' || CAST(user_id % 7 AS STRING) || ',\"time\":' || CAST(event_id AS STRING) "
    "|| CASE user_id % 7 "
    + " ".join(
        [
            _legacy(0, [("iLightLoc", _LIGHT), ("fAtmoLoc", _ATMO)]),
            _legacy(1, [("fTemp1A", _TEMP), ("fHumi1", _HUMI)]),
            _legacy(2, [("fTemp2A", _TEMP)]),
            _legacy(3, [("fTemp3A", _TEMP)]),
            _legacy(4, [("fTemp4A", _TEMP), ("fHumi4]", _HUMI)]),
            _legacy(5, [("fTemp5A", _TEMP), ("fHumi5", _HUMI)]),
        ]
    )
    + " ELSE '' END || CASE WHEN user_id % 7 IN (0, 6) OR event_id % 11 = 0 THEN '' "
    "ELSE ',\"fVolt' || CAST(user_id % 7 AS STRING) || '\":' || "
    + _two_decimals("2 + (event_id % 150) / 100.0")
    + " END || '}'",
}

MESSAGES = {
    "seq": "event_id",
    "ts": "ts",
    "topic": "'Sensor' || CAST(user_id % 10 AS STRING) || '/' || " + POINTS["field"],
    "payload": _two_decimals(POINTS["value"]) + " || '0'",
}

# The same with payloads that are no finite numbers here and there.
NOISY_MESSAGES = {
    **MESSAGES,
    "payload": "CASE event_id % 31 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN '-Infinity' WHEN 3 THEN 'off' ELSE "
    + MESSAGES["payload"]
    + " END",
}

# Messages to the actuator and the display, with numbers as people send them.
CONTROL_MESSAGES = {
    "seq": "event_id",
    "ts": "ts",
    "topic": "CASE event_type WHEN 'signup' THEN 'ValveControl/SetPos' WHEN 'click' THEN 'ValveControl/SetInt' "
    "WHEN 'view' THEN 'Thermo' WHEN 'purchase' THEN 'Humi' ELSE 'Sensor1/Err' END",
    "payload": "CASE event_id % 5 WHEN 0 THEN CAST(event_id % 6 AS STRING) WHEN 1 THEN ' ' || "
    "CAST(event_id % 6 AS STRING) || 'x' WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE '-' || CAST(event_id % 6 AS STRING) "
    "END",
}

# Radio values as floats, as a packet carries them, with unset sentinels here and there.
RADIO = {
    "seq": "event_id",
    "ts": "ts",
    "channel": "CAST(user_id % 10 AS INT)",
    "version": "CAST(1 - event_id % 2 AS INT)",
    "caps": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 128 AS INT) END",
    "temp_a": f"CAST(CASE event_id % 7 WHEN 0 THEN -127 WHEN 1 THEN -99 ELSE ({_V} % 9000 - 4500) / 100.0 END AS DOUBLE)",
    "temp_b": f"CAST(CASE event_id % 11 WHEN 0 THEN -127 ELSE (({_V} * 7) % 9000 - 4500) / 100.0 END AS DOUBLE)",
    "humi": f"CAST(CASE event_id % 13 WHEN 0 THEN -1 WHEN 1 THEN 999999 WHEN 2 THEN CAST('NaN' AS DOUBLE) "
    f"ELSE ({_V} % 11000) / 100.0 END AS DOUBLE)",
    "volt": f"CAST(CASE event_id % 17 WHEN 0 THEN -1 ELSE ({_V} % 600) / 100.0 END AS DOUBLE)",
    "nLux": f"CAST(CASE event_id % 19 WHEN 0 THEN -99 WHEN 1 THEN 999999 ELSE {_V} % 2000 END AS INT)",
}

# Commands to a valve; a device is a channel.
COMMANDS = {
    "device": "CAST(user_id % 10 AS INT)",
    "ts": "ts",
    "seq": "event_id",
    "set_pos": "CASE WHEN event_type = 'signup' THEN CAST(event_id % 6 AS INT) END",
    "manual": "CASE WHEN event_type = 'click' THEN CAST(event_id % 7 AS INT) END",
    "on_ticks": "CASE WHEN event_type = 'purchase' THEN CAST(1 + event_id % 8 AS INT) END",
}

VALVE_LOG = {
    "device": "CAST(user_id % 10 AS INT)",
    "ts": "ts",
    "seq": "event_id",
    "kind": "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'ack' "
    "ELSE 'tick' END WHEN 'signup' THEN 'reconnect' WHEN 'purchase' THEN 'dac_ok' ELSE 'tick' END",
    "code": "CASE WHEN event_type = 'error' THEN CAST(1 + event_id % 6 AS INT) END",
}

# What a valve measures itself.
VALVE_MEASUREMENTS = {
    "device": "CAST(user_id % 10 AS INT)",
    "ts": "ts",
    "seq": "event_id",
    "temp_in": f"CASE WHEN event_type = 'view' THEN CAST(CAST({_V} % 4000 AS DOUBLE) / 100 AS DOUBLE) END",
    "temp_out": f"CASE WHEN event_type = 'purchase' THEN CAST(CAST({_V} % 5000 - 2000 AS DOUBLE) / 100 AS DOUBLE) END",
    "light": f"CASE WHEN event_type = 'signup' THEN CAST({_V} AS DOUBLE) END",
}

# Keys pressed at a valve.
PRESSES = {
    "device": "CAST(user_id % 10 AS INT)",
    "ts": "ts",
    "seq": "event_id",
    "press": "CASE WHEN event_id % 11 = 0 THEN 'auto' WHEN event_type IN ('click', 'view') THEN 'up' "
    "WHEN event_type IN ('purchase', 'signup') THEN 'down' ELSE 'other' END",
}

# A log of tier changes: a tier per user, altered with every event.
TIER_LOG = {
    "tier": "'tier_' || CAST(user_id AS STRING)",
    "duration": "CASE event_id % 6 WHEN 0 THEN CAST(1 + event_id % 104 AS STRING) || 'w' "
    "WHEN 1 THEN CAST(event_id % 20000 AS STRING) || 'h0m0s' WHEN 2 THEN 'INF' WHEN 3 THEN '0s' "
    "WHEN 4 THEN CAST(1 + event_id % 365 AS STRING) || 'd' ELSE CAST(1 + event_id % 48 AS STRING) || 'h' END",
    "seq": "event_id",
}

_SPEC_NAME = "'cq_' || CAST({width} AS STRING) || '_U' || CAST(user_id AS STRING) || '_' || CAST({kind} AS STRING)"
# Rollup definitions written by clicks and views, and dropped by errors.
SPECS_CREATED = {
    "name": _SPEC_NAME.format(width="event_id % 3", kind="event_id % 5"),
    "agg": "CASE event_id % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'min' WHEN 2 THEN 'max' ELSE 'last' END",
    "width_s": "CAST(300 * (1 + event_id % 12) AS BIGINT)",
    "seq": "event_id",
}
SPECS_DROPPED = {"name": _SPEC_NAME.format(width="event_id % 3", kind="event_id % 5"), "seq": "event_id"}


def sql(view: dict[str, str], source: str) -> str:
    """The view as a subquery."""
    return "(SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in view.items()) + f" FROM {source})"


SQL = {
    "points": sql(POINTS, "events"),
    "tagged_points": sql(TAGGED_POINTS, "events"),
    "spec_points": sql(SPEC_POINTS, "events"),
    "points_long": sql(POINTS_LONG, "lineitem"),
    "readings": sql(READINGS, "events"),
    "raw_readings": sql(RAW_READINGS, "events"),
    "frames": sql(FRAMES, sql(READINGS, "events") + " r"),
    "frame_parts": sql(
        FRAME_PARTS,
        "(SELECT * FROM "
        + sql(FRAMES, sql(READINGS, "events") + " r")
        + " f, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) h(half)) parts",
    ),
    "legacy_frames": sql(LEGACY_FRAMES, "events"),
    "legacy_readings": sql(LEGACY_READINGS, "events"),
    "messages": sql(MESSAGES, "events"),
    "noisy_messages": sql(NOISY_MESSAGES, "events"),
    "control_messages": sql(CONTROL_MESSAGES, "events"),
    "radio": sql(RADIO, "events"),
    "commands": sql(COMMANDS, "events"),
    "valve_log": sql(VALVE_LOG, "events"),
    "valve_measurements": sql(VALVE_MEASUREMENTS, "events"),
    "presses": sql(PRESSES, "events"),
    "tier_log": sql(TIER_LOG, "events"),
    "specs_created": sql(SPECS_CREATED, "(SELECT * FROM events WHERE event_type IN ('click', 'view')) e"),
    "specs_dropped": sql(SPECS_DROPPED, "(SELECT * FROM events WHERE event_type = 'error') e"),
}


def _select(table: DataFrame, view: dict[str, str]) -> DataFrame:
    return table.selectExpr(*[f"{expr} AS {name}" for name, expr in view.items()])


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    def over_events(self, view: dict[str, str]) -> DataFrame:
        return _select(self.events, view)

    @property
    def points(self) -> DataFrame:
        return self.over_events(POINTS)

    @property
    def spec_points(self) -> DataFrame:
        return self.over_events(SPEC_POINTS)

    @property
    def points_long(self) -> DataFrame:
        return _select(self.table("lineitem"), POINTS_LONG)

    @property
    def readings(self) -> DataFrame:
        return self.over_events(READINGS)

    @property
    def frames(self) -> DataFrame:
        return _select(self.readings, FRAMES)

    @property
    def frame_parts(self) -> DataFrame:
        halves = self.frames.withColumn("half", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
        return _select(halves, FRAME_PARTS)

    @property
    def radio(self) -> DataFrame:
        return self.over_events(RADIO)

    def stream(self, view: dict[str, str], time: str) -> DataFrame:
        return event_time(_select(stream_table(self.spark, self.folder, "events"), view), time)
