"""Silence, staleness and last-known-value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.constants import SCALED_FIELDS, STALE_BRIDGE_S, STALE_DISPLAY_S, STALE_HUB_S
from hearthline.functions import scalar as S
from hearthline.operators import health as H
from hearthline.operators.normalize import gate
from hearthline.plans.normalize import REGISTRY_SQL
from hearthline.plans.registry import query
from hearthline.plans.views import RAW_READINGS, Views
from hearthline.sources import dims


@query(
    "since_last",
    """
    SELECT seq, channel, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, seq))
           / CAST(1000000 AS DOUBLE) AS since_s
    FROM {readings}
    """,
)
def since_last(v: Views):
    return H.since_last(v.readings.select("seq", "ts", "channel")).select("seq", "channel", "since_s")


@query(
    "age_text",
    """
    SELECT seq, CAST(s // 60 AS STRING) || ':' || lpad(CAST(s % 60 AS STRING), 2, '0') AS age
    FROM (SELECT seq, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, seq)) // 1000000 AS s
          FROM {readings}) WHERE s IS NOT NULL
    """,
)
def age_text(v: Views):
    aged = H.since_last(v.readings.select("seq", "ts", "channel")).where(F.col("since_s").isNotNull())
    return aged.select("seq", S.age_text(F.col("since_s")).alias("age"))


def _gaps_sql(limit_s: int) -> str:
    return f"""
    SELECT channel, p AS silent_from, ts AS silent_to, (epoch_us(ts) - epoch_us(p)) / CAST(1000000 AS DOUBLE) AS gap_s
    FROM (SELECT channel, ts, lag(ts) OVER (PARTITION BY channel ORDER BY ts, seq) AS p FROM {{readings}})
    WHERE epoch_us(ts) - epoch_us(p) > {limit_s} * 1000000
    """


@query("silence_gaps", _gaps_sql(STALE_BRIDGE_S))
def silence_gaps(v: Views):
    return H.silence_gaps(v.readings.select("seq", "ts", "channel"), STALE_BRIDGE_S)


@query(
    "silence_alarms",
    f"""
    SELECT unnest(generate_series(silent_from + INTERVAL '{STALE_BRIDGE_S} seconds', silent_to, INTERVAL '10 minutes')) AS ts,
           'Sensor' || CAST(channel AS STRING) || '/Err' AS topic, '1' AS payload
    FROM ({_gaps_sql(STALE_BRIDGE_S)})
    """,
)
def silence_alarms(v: Views):
    gaps = H.silence_gaps(v.readings.select("seq", "ts", "channel"), STALE_BRIDGE_S)
    return H.silence_alarms(gaps, STALE_BRIDGE_S, every_s=600)


@query(
    "silence_open_alarms",
    f"""
    SELECT unnest(generate_series(silent_from + INTERVAL '{STALE_BRIDGE_S} seconds', silent_to, INTERVAL '10 minutes')) AS ts,
           'Sensor' || CAST(channel AS STRING) || '/Err' AS topic, '1' AS payload
    FROM (SELECT channel, silent_from, silent_to FROM ({_gaps_sql(STALE_BRIDGE_S)})
          UNION ALL
          SELECT channel, max(ts) AS silent_from, (SELECT max(ts) FROM events) + INTERVAL '1 hour' AS silent_to
          FROM {{readings}} GROUP BY channel)
    """,
)
def silence_open_alarms(v: Views):
    """An hour after the newest reading every sensor is silent; alarms go on until then."""
    as_of = v.events.agg(F.max("ts")).scalar() + F.expr("INTERVAL 1 HOUR")
    gaps = H.silence_gaps(v.readings.select("seq", "ts", "channel"), STALE_BRIDGE_S, as_of=as_of)
    return H.silence_alarms(gaps, STALE_BRIDGE_S, every_s=600, as_of=as_of)


@query(
    "stale_sensors",
    " UNION ALL ".join(
        f"""
    SELECT '{board}' AS board, s.channel, l.last_seen,
           (epoch_us((SELECT max(ts) FROM events)) + 150000000 - epoch_us(l.last_seen)) / CAST(1000000 AS DOUBLE) AS age_s
    FROM {REGISTRY_SQL} LEFT JOIN (SELECT channel, max(ts) AS last_seen FROM {{readings}} GROUP BY channel) l
         ON s.channel = l.channel
    WHERE l.last_seen IS NULL
       OR epoch_us((SELECT max(ts) FROM events)) + 150000000 - epoch_us(l.last_seen) > {limit} * 1000000
    """
        for board, limit in (("hub", STALE_HUB_S), ("bridge", STALE_BRIDGE_S), ("display", STALE_DISPLAY_S))
    ),
)
def stale_sensors(v: Views):
    readings = v.readings.select("channel", "ts")
    as_of = v.events.agg(F.max("ts")).scalar() + F.expr("INTERVAL 150 SECONDS")
    limits_s = {"hub": STALE_HUB_S, "bridge": STALE_BRIDGE_S, "display": STALE_DISPLAY_S}
    return H.stale_sensors(readings, dims.sensors(v.spark), as_of, limits_s)


@query(
    "first_seen",
    """
    SELECT node, mac, first_ts FROM (
        SELECT user_id AS node, printf('%012X', event_id * 7919 + user_id) AS mac, ts AS first_ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
    """,
)
def first_seen(v: Views):
    packets = v.events.select(
        F.col("user_id").alias("node"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 7919 + F.col("user_id")).alias("mac"),
    )
    seen = H.first_seen(packets, "mac", ("node",))
    return seen.withColumn("mac", F.lpad(F.hex("mac"), 12, "0"))


@query(
    "carry_forward",
    "SELECT seq, channel, "
    + ", ".join(
        f'last_value({f} IGNORE NULLS) OVER w AS "{f}"' for f in SCALED_FIELDS
    )
    + " FROM {readings} WINDOW w AS (PARTITION BY channel ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)",
)
def carry_forward(v: Views):
    return H.carry_forward(v.readings, SCALED_FIELDS).select("seq", "channel", *SCALED_FIELDS)


@query(
    "capability_lag",
    f"""
    WITH known AS (SELECT r.*, coalesce(last_value(r.caps IGNORE NULLS) OVER (PARTITION BY r.channel ORDER BY r.ts, r.seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.static_caps) AS gate_caps
                   FROM (SELECT seq, ts, channel, CASE WHEN seq % 2 = 0 THEN caps END AS caps,
                                iTempA, iTempB, iHumi, iVolt FROM {{raw_readings}}) r
                   LEFT JOIN {REGISTRY_SQL} ON r.channel = s.channel)
    SELECT seq, channel, gate_caps, CASE WHEN (gate_caps & 1) <> 0 THEN iTempA END AS "iTempA",
           CASE WHEN (gate_caps & 2) <> 0 THEN iTempB END AS "iTempB",
           CASE WHEN (gate_caps & 8) <> 0 THEN iHumi END AS "iHumi",
           CASE WHEN (gate_caps & 4) <> 0 THEN iVolt END AS "iVolt"
    FROM known
    """,
)
def capability_lag(v: Views):
    packets = v.over_events(RAW_READINGS).withColumn("caps", F.when(F.col("seq") % 2 == 0, F.col("caps")))
    gated = H.gate_by_previous(packets, dims.sensors(v.spark))
    return gated.select("seq", "channel", "gate_caps", "iTempA", "iTempB", "iHumi", "iVolt")


@query(
    "capability_gate",
    """
    SELECT seq, channel, CASE WHEN (caps & 1) <> 0 THEN iTempA END AS "iTempA",
           CASE WHEN (caps & 2) <> 0 THEN iTempB END AS "iTempB", CASE WHEN (caps & 8) <> 0 THEN iHumi END AS "iHumi",
           CASE WHEN (caps & 4) <> 0 THEN iVolt END AS "iVolt"
    FROM {raw_readings}
    """,
)
def capability_gate(v: Views):
    """Gated by the packet's own capabilities; ``capability_lag`` is the radio hub's way."""
    return gate(v.over_events(RAW_READINGS), F.col("caps")).drop("ts", "caps")


@query(
    "sample_last_15s",
    """
    SELECT channel, sent_at, ts, seq, caps, iTempA AS "iTempA", iHumi AS "iHumi", iVolt AS "iVolt" FROM (
        SELECT *, time_bucket(INTERVAL '15 seconds', ts) + INTERVAL '15 seconds' AS sent_at,
               row_number() OVER (PARTITION BY channel, time_bucket(INTERVAL '15 seconds', ts)
                                  ORDER BY ts DESC, seq DESC) AS rn FROM {readings}) WHERE rn = 1
    """,
)
def sample_last_15s(v: Views):
    return H.sample_last(v.readings.select("seq", "ts", "channel", "caps", "iTempA", "iHumi", "iVolt"))
