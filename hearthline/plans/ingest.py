"""Packet, frame and message queries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.constants import LIMITS
from hearthline.functions.scalar import fixed_point
from hearthline.operators import ingest as I
from hearthline.operators.health import wide_snapshot as snapshot
from hearthline.operators.normalize import plausible
from hearthline.operators.ordered import micros
from hearthline.plans.registry import query
from hearthline.plans.views import CONTROL_MESSAGES, LEGACY_FRAMES, LEGACY_READINGS, MESSAGES, NOISY_MESSAGES, Views
from hearthline.sources import packets as P

_FRAME_RE = r"%([^$]*)\$"


@query(
    "split_frames",
    f"""
    SELECT seq, ts, CAST(0 AS INT) AS frame_no, regexp_extract(text, '{_FRAME_RE}', 1) AS payload
    FROM {{frames}} WHERE regexp_matches(text, '{_FRAME_RE}')
    """,
)
def split_frames(v: Views):
    return I.split_frames(v.frames).drop("channel")


@query(
    "split_frames_across_rows",
    f"""
    WITH whole AS (SELECT port, string_agg(text, '' ORDER BY seq) AS text FROM {{frame_parts}} GROUP BY port)
    SELECT * FROM (SELECT port, unnest(regexp_extract_all(text, '{_FRAME_RE}', 1)) AS payload FROM whole)
    """,
)
def split_frames_across_rows(v: Views):
    return I.split_frames_across_rows(v.frame_parts, ["port"], micros(F.col("ts"))).drop("seq")


_SENT = ("iTempA", "iTempB", "iHumi", "iVolt", "iLight", "iAtmo")
_ABSENT = ("nLux", "nRed", "nGreen", "nBlue", "nClear", "nColor")


@query(
    "parse_frames",
    f"""
    SELECT seq, seq % 23 = 0 AS bad_json, CASE WHEN seq % 23 <> 0 THEN channel END AS sensor,
           CAST(CASE WHEN seq % 23 <> 0 THEN seq END AS INT) AS time, CASE WHEN seq % 23 <> 0 THEN caps END AS "SensCap",
           {', '.join(f'CASE WHEN seq % 23 <> 0 THEN {f} END AS "{f}"' for f in _SENT)},
           {', '.join(f'CAST(NULL AS INT) AS "{f}"' for f in _ABSENT)},
           CAST(CASE WHEN seq % 23 <> 0 THEN caps + {' + '.join(f'coalesce({f}, 0)' for f in _SENT)}
                + CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END END AS INT) AS "iCSum"
    FROM {{readings}} WHERE seq % 29 <> 0
    """,
)
def parse_frames(v: Views):
    return I.parse_frames(I.split_frames(v.frames)).drop("ts", "channel", "frame_no")


_LEGACY_KEYS = {
    "fTempA": ["fTemp1A", "fTemp2A", "fTemp3A", "fTemp4A", "fTemp5A"],
    "fHumi": ["fHumi1", "fHumi5"],
    "fVolt": ["fVolt1", "fVolt2", "fVolt3", "fVolt4", "fVolt5"],
    "iLight": ["iLightLoc"],
    "fAtmo": ["fAtmoLoc"],
}


def _legacy_value(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CAST(payload ->> '$.{k}' AS DOUBLE)" for k in keys) + ", NULL)"


@query(
    "parse_frames_legacy",
    f"""
    WITH parsed AS (SELECT seq, CAST(payload ->> '$.sensor' AS INT) AS sensor, CAST(payload ->> '$.time' AS INT) AS time,
                           {', '.join(f'{_legacy_value(k)} AS "{f}"' for f, k in _LEGACY_KEYS.items())}
                    FROM {{legacy_frames}}),
    summed AS (SELECT *, CASE WHEN sensor = 0 THEN coalesce("iLight", 999999) + coalesce("fAtmo", 999999)
                              WHEN sensor IN (1, 4, 5) THEN coalesce("fTempA", 999999) + coalesce("fHumi", 999999)
                                                            + coalesce("fVolt", 999999)
                              WHEN sensor IN (2, 3) THEN coalesce("fTempA", 999999) + coalesce("fVolt", 999999)
                         END AS total FROM parsed),
    judged AS (SELECT *, coalesce(trunc(total) < 999999, FALSE) AS accepted FROM summed)
    SELECT seq, sensor, time, accepted,
           {', '.join(f'CASE WHEN accepted THEN "{f}" END AS "{f}"' for f in _LEGACY_KEYS)}
    FROM judged
    """,
)
def parse_frames_legacy(v: Views):
    return I.parse_frames_legacy(v.over_events(LEGACY_FRAMES))


def _limited(field: str) -> str:
    lo, inclusive, hi = LIMITS[field]
    return f"CASE WHEN {field} {'>=' if inclusive else '>'} {lo} AND {field} < {hi} THEN {field} END AS {field}"


_PLAUSIBLE_SQL = "(SELECT seq, ts, channel, caps, " + ", ".join(_limited(f) for f in LIMITS) + " FROM {readings})"


@query(
    "to_frames",
    f"""
    SELECT seq, channel, '%{{"sensor":' || CAST(channel AS STRING) || ',"time":' || CAST(seq AS STRING) || ',"SensCap":'
           || CAST(caps AS STRING) || {' || '.join(f"coalesce(',\"{f}\":' || CAST({f} AS STRING), '')" for f in _SENT)}
           || ',"iCSum":' || CAST(caps + {' + '.join(f'coalesce({f}, 0)' for f in _SENT)} AS STRING) || '}}$' AS text
    FROM """
    + _PLAUSIBLE_SQL,
)
def to_frames(v: Views):
    return I.to_frames(v.readings, F.col("seq"))


def _legacy_sql(sensor: int, keys: dict[str, str]) -> str:
    body = " || ".join(f"coalesce(',\"{key}\":' || CAST({field} AS STRING), '')" for field, key in keys.items())
    return f"WHEN {sensor} THEN {body}"


_LEGACY_SENT = {
    0: {"iLight": "iLightLoc", "fAtmo": "fAtmoLoc"},
    1: {"fTempA": "fTemp1A", "fHumi": "fHumi1", "fVolt": "fVolt1"},
    2: {"fTempA": "fTemp2A", "fVolt": "fVolt2"},
    3: {"fTempA": "fTemp3A", "fVolt": "fVolt3"},
    4: {"fTempA": "fTemp4A", "fHumi": "fHumi4]", "fVolt": "fVolt4"},
    5: {"fTempA": "fTemp5A", "fHumi": "fHumi5", "fVolt": "fVolt5"},
}


@query(
    "to_frames_legacy",
    f"""
    SELECT seq, channel, '%{{"sensor":' || CAST(channel AS STRING) || ',"time":' || CAST(seq AS STRING) || CASE channel
           {' '.join(_legacy_sql(s, k) for s, k in _LEGACY_SENT.items())} END || '}}$' AS text
    FROM {{legacy_readings}} WHERE channel <= 5
    """,
)
def to_frames_legacy(v: Views):
    return I.to_frames_legacy(v.over_events(LEGACY_READINGS), F.col("seq"))


def _legacy_message_sql(field: str) -> str:
    channels = ", ".join(str(s) for s, keys in _LEGACY_SENT.items() if field in keys)
    payload = f"CAST(CAST({field} AS DECIMAL(12, 2)) AS STRING)"
    if field == "iLight":
        payload = f"lpad(CAST({field} AS STRING), CAST(greatest(3, length(CAST({field} AS STRING))) AS INT), ' ')"
    return (
        "SELECT seq, ts, CASE channel WHEN 0 THEN 'SensorLoc' ELSE 'Sensor' || CAST(channel AS STRING) END "
        f"|| '/{field}' AS topic, {payload} AS payload FROM {{legacy_readings}} "
        f"WHERE channel IN ({channels}) AND {field} IS NOT NULL"
    )


@query(
    "to_messages_legacy",
    " UNION ALL ".join(_legacy_message_sql(f) for f in ("fTempA", "fHumi", "fVolt", "iLight", "fAtmo")),
)
def to_messages_legacy(v: Views):
    return I.to_messages_legacy(v.over_events(LEGACY_READINGS))


def _message_sql(field: str, name: str) -> str:
    sign = f"CASE WHEN {field} < 0 THEN '-' ELSE '' END"
    digits = f"CAST(abs({field}) // 100 AS STRING) || '.' || lpad(CAST(abs({field}) % 100 AS STRING), 2, '0') || '0'"
    return (
        f"SELECT seq, ts, 'Sensor' || CAST(channel AS STRING) || '/{name}' AS topic, {sign} || {digits} AS payload "
        f"FROM plausible WHERE {field} IS NOT NULL"
    )


@query(
    "to_messages",
    f"WITH plausible AS {_PLAUSIBLE_SQL} "
    + " UNION ALL ".join(
        _message_sql(field, name)
        for field, name in (
            ("iTempA", "fTempA"),
            ("iTempB", "fTempB"),
            ("iVolt", "fVolt"),
            ("iHumi", "fHumi"),
            ("iLight", "iLight"),
            ("iAtmo", "iAtmo"),
        )
    ),
)
def to_messages(v: Views):
    return I.to_messages(plausible(v.readings))


_ATOI = r"coalesce(TRY_CAST(regexp_extract(payload, '^\s*([+-]?\d+)', 1) AS INT), 0)"


@query(
    "route_messages",
    f"""
    SELECT seq, topic, CASE WHEN topic = 'ValveControl/SetPos' THEN {_ATOI} END AS set_pos,
           CASE WHEN topic = 'ValveControl/SetInt' THEN {_ATOI} END AS set_int,
           CASE WHEN topic = 'Thermo' THEN payload || ' °C' END AS thermo_text,
           CASE WHEN topic = 'Humi' THEN payload || ' %' END AS humi_text
    FROM {{control_messages}}
    """,
)
def route_messages(v: Views):
    return I.route_messages(v.over_events(CONTROL_MESSAGES)).drop("ts", "payload")


@query(
    "messages_to_points",
    "SELECT 'autogen' AS tier, measurement, time, field, round(value, 2) AS value, write_seq FROM {points}",
)
def messages_to_points(v: Views):
    return I.messages_to_points(v.over_events(MESSAGES))


@query(
    "frames_to_points",
    f"""
    WITH plausible AS (SELECT * FROM {_PLAUSIBLE_SQL}
                       WHERE seq % 17 <> 0 AND seq % 23 <> 0 AND seq % 29 <> 0)
    """
    + " UNION ALL ".join(
        f"SELECT 'autogen' AS tier, CASE WHEN channel = 0 THEN 'SensorLoc' ELSE 'sSens' || CAST(channel AS STRING) END "
        f"AS measurement, ts AS time, '{name}' AS field, {field} / CAST(100 AS DOUBLE) AS value, seq AS write_seq "
        f"FROM plausible WHERE {field} IS NOT NULL"
        for field, name in (
            ("iTempA", "fTempA"),
            ("iTempB", "fTempB"),
            ("iVolt", "fVolt"),
            ("iHumi", "fHumi"),
            ("iLight", "iLight"),
            ("iAtmo", "iAtmo"),
        )
    ),
)
def frames_to_points(v: Views):
    """The whole way from serial text to stored points."""
    return I.frames_to_points(v.frames)


@query(
    "ingest_rejects",
    f"""
    SELECT seq, ts, CAST(0 AS INT) AS frame_no, regexp_extract(text, '{_FRAME_RE}', 1) AS payload,
           CASE WHEN seq % 23 = 0 THEN 'json' WHEN seq % 17 = 0 THEN 'checksum' ELSE 'channel' END AS reason
    FROM {{frames}} WHERE seq % 29 <> 0 AND (seq % 23 = 0 OR seq % 17 = 0 OR channel = 0)
    """,
)
def ingest_rejects(v: Views):
    """What the receiver of channels 1 to 9 does not take."""
    return I.ingest_rejects(v.frames, (1, 9))


@query(
    "message_rejects",
    "SELECT seq, ts, topic, payload, 'number' AS reason FROM {noisy_messages} WHERE seq % 31 < 4",
)
def message_rejects(v: Views):
    return I.message_rejects(v.over_events(NOISY_MESSAGES))


@query(
    "noisy_messages_to_points",
    "SELECT 'autogen' AS tier, measurement, time, field, round(value, 2) AS value, write_seq FROM {points} "
    "WHERE write_seq % 31 >= 4",
)
def noisy_messages_to_points(v: Views):
    """Payloads that are no finite numbers do not reach the points."""
    return I.messages_to_points(v.over_events(NOISY_MESSAGES))


_SLOTS = {
    "field1": (0, "iTempA"),
    "field2": (0, "iHumi"),
    "field3": (0, "iLight"),
    "field4": (0, "iAtmo"),
    "field5": (1, "iTempA"),
    "field6": (2, "iTempA"),
    "field7": (2, "iVolt"),
    "field8": (1, "iHumi"),
}


@query(
    "wide_snapshot",
    "SELECT "
    + ", ".join(
        f"arg_max({field}, seq) FILTER (WHERE channel = {channel} AND {field} IS NOT NULL) AS {slot}"
        for slot, (channel, field) in _SLOTS.items()
    )
    + f" FROM {_PLAUSIBLE_SQL}",
)
def wide_snapshot(v: Views):
    return snapshot(plausible(v.readings), _SLOTS)


# The order and types of the members as the senders have them, padding included, written here a second time so that the
# decoder is not checked against itself (fixed values).
_SENT_V1, _SENT_V0, _SENT_LORA = "<iffffiHxxiiiiii", "<iffff", "<iii"
_COLOURS = {"nColor": 5003, "nLux": 1009, "nRed": 251, "nGreen": 241, "nBlue": 239, "nClear": 997}


def _sent(df: DataFrame, form: str, columns: list[str]) -> DataFrame:
    """``seq`` and the bytes a sender makes of the columns, member by member."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]])
            made = pa.array([struct.pack(form, *row) for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["seq", "payload"])

    return df.select("seq", *columns).mapInArrow(pack, "seq bigint, payload binary")


def _packed(v: Views):
    """The readings as radio packets: version 1 for even numbers, version 0 for odd ones."""
    floats = v.readings.select(
        "seq",
        "channel",
        "caps",
        *[
            (F.coalesce(F.col(c), F.lit(0)) / 100).cast("float").alias(n)
            for n, c in (("temp_a", "iTempA"), ("temp_b", "iTempB"), ("humi", "iHumi"), ("volt", "iVolt"))
        ],
    )
    colours = [(F.col("seq") % n).cast("int").alias(c) for c, n in _COLOURS.items()]
    v1 = floats.where("seq % 2 = 0").select("*", F.lit(1).alias("version"), *colours)
    measured = ["channel", "temp_a", "temp_b", "humi", "volt"]
    new = _sent(v1, _SENT_V1, [*measured, "version", "caps", *_COLOURS])
    return new.unionByName(_sent(floats.where("seq % 2 = 1"), _SENT_V0, measured))


@query(
    "decode_packets",
    f"""
    SELECT seq, channel, CAST(1 - seq % 2 AS INT) AS version, CASE WHEN seq % 2 = 0 THEN caps END AS caps,
           coalesce(iTempA, 0) AS "iTempA", coalesce(iTempB, 0) AS "iTempB", coalesce(iHumi, 0) AS "iHumi",
           coalesce(iVolt, 0) AS "iVolt",
           {', '.join(f'CAST(CASE WHEN seq % 2 = 0 THEN seq % {n} END AS INT) AS "{c}"' for c, n in _COLOURS.items())}
    FROM {{readings}}
    """,
)
def decode_packets(v: Views):
    decoded = P.decode_packets(_packed(v))
    scaled = (("iTempA", "temp_a"), ("iTempB", "temp_b"), ("iHumi", "humi"), ("iVolt", "volt"))
    return decoded.select(
        "seq", "channel", "version", "caps", *[fixed_point(F.col(c)).alias(n) for n, c in scaled], *_COLOURS
    )


@query(
    "undecodable_packets",
    """
    SELECT seq, CAST(CASE WHEN seq % 10 <> 3 THEN CASE WHEN seq % 2 = 0 THEN 51 ELSE 19 END END AS INT) AS n_bytes
    FROM {readings} WHERE seq % 9 = 0 OR seq % 10 = 3
    """,
)
def undecodable_packets(v: Views):
    """Packets that lost their last byte, and packets without content, as output beside the decoded ones."""
    whole = F.col("payload")
    damaged = F.when(F.col("seq") % 10 == 3, F.lit(None)).when(F.col("seq") % 9 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
    kept = F.when((F.col("seq") % 10 == 3) | (F.col("seq") % 9 == 0), damaged).otherwise(whole)
    packets = _packed(v).withColumn("payload", kept)
    return P.undecodable(packets, "payload", [P.RADIO_V1, P.RADIO_V0]).select("seq", F.length("payload").alias("n_bytes"))


@query(
    "decode_lora",
    """
    SELECT event_id AS seq, CAST(user_id % 10 AS INT) AS channel, CAST(floor(value * 100) AS INT) - 20000 AS value,
           CASE event_id % 5 WHEN 0 THEN 'rain' WHEN 1 THEN 'temp' WHEN 2 THEN 'humi' WHEN 3 THEN 'battery'
                ELSE 'unknown' END AS source
    FROM events
    """,
)
def decode_lora(v: Views):
    messages = v.events.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 5).cast("int").alias("source_code"),
        (F.col("user_id") % 10).cast("int").alias("channel"),
        F.expr("CAST(floor(value * 100) AS INT) - 20000").alias("value"),
    )
    return P.decode_lora(_sent(messages, _SENT_LORA, ["source_code", "channel", "value"])).drop("source_code")
