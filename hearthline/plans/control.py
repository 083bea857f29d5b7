"""Valve control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.constants import ERROR_TEXTS
from hearthline.operators import control as C
from hearthline.plans.registry import query
from hearthline.plans.views import COMMANDS, PRESSES, VALVE_LOG, VALVE_MEASUREMENTS, Views

_TICKS = """
    spans AS (SELECT device, min(ts) AS a, max(ts) AS b FROM {commands} GROUP BY device),
    ticks AS (SELECT device, unnest(generate_series(a, b, INTERVAL '1 minute')) AS ts FROM spans)
"""

# What was received last before each tick.
_IN_FORCE = f"""
    {_TICKS},
    remote AS (SELECT t.*, s.set_pos FROM ticks t
               ASOF LEFT JOIN (SELECT device, ts, set_pos FROM {{commands}} WHERE set_pos IS NOT NULL) s
                 ON t.device = s.device AND t.ts >= s.ts),
    both_ AS (SELECT r.*, m.manual FROM remote r
              ASOF LEFT JOIN (SELECT device, ts, manual FROM {{commands}} WHERE manual IS NOT NULL) m
                ON r.device = m.device AND r.ts >= m.ts)
"""


def _spans(v: Views):
    commands = v.over_events(COMMANDS)
    return commands.groupBy("device").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "setpoint_asof",
    f"""
    WITH {_TICKS}
    SELECT t.device, t.ts, s.set_pos FROM ticks t
    ASOF LEFT JOIN (SELECT device, ts, set_pos FROM {{commands}} WHERE set_pos IS NOT NULL) s
      ON t.device = s.device AND t.ts >= s.ts
    """,
)
def setpoint_asof(v: Views):
    set_points = v.over_events(COMMANDS).where("set_pos IS NOT NULL")
    return C.asof(C.minute_ticks(_spans(v), "device"), set_points, ["device"], ["set_pos"])


@query(
    "effective_setpoint",
    f"""
    WITH {_IN_FORCE}
    SELECT device, ts, CASE WHEN manual < 6 THEN manual ELSE coalesce(set_pos, 5) END AS set_point,
           CASE WHEN coalesce(manual, 6) < 6 THEN 'MAN' ELSE 'AUTO' END AS mode
    FROM both_
    """,
)
def effective_setpoint(v: Views):
    commands = v.over_events(COMMANDS).where("set_pos IS NOT NULL OR manual IS NOT NULL")
    ticks = C.minute_ticks(_spans(v), "device")
    return C.effective_setpoint(ticks, commands).select("device", "ts", "set_point", "mode")


@query(
    "manual_from_presses",
    """
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, seq) AS i FROM {presses}),
    r AS (SELECT device, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, '' AS press, 6 AS manual
          FROM p WHERE i = 1
          UNION ALL
          SELECT p.device, p.i, p.seq, p.ts, p.press, CASE p.press WHEN 'auto' THEN 6 WHEN 'up' THEN least(r.manual + 1, 5)
                 WHEN 'down' THEN greatest(r.manual - 1, 0) ELSE r.manual END
          FROM r JOIN p ON p.device = r.device AND p.i = r.i + 1)
    SELECT device, ts, seq, press, manual FROM r WHERE i > 0
    """,
)
def manual_from_presses(v: Views):
    """The mode after each key press."""
    return C.manual_from_presses(v.over_events(PRESSES))


def _timeline(v: Views):
    commands = v.over_events(COMMANDS).where("set_pos IS NOT NULL OR manual IS NOT NULL OR on_ticks IS NOT NULL")
    return C.valve_timeline(commands, _spans(v))


# Tick by tick, a list of 240 ticks in each step of the recursion.
_STEP = 240
_FREE = "x.sp NOT IN (1, 2) AND x.sp >= 0"
_TURNS = "(x.sp IN (1, 2) AND a.c >= CASE WHEN x.sp = 1 AND NOT a.o THEN 2 * x.n ELSE x.n END)"
_POSITION = f"CASE WHEN {_TURNS} THEN CASE WHEN a.o THEN 0 ELSE 3 END WHEN {_FREE} THEN x.sp ELSE a.p END"
_TIMELINE = f"""
    {_IN_FORCE},
    ruled AS (SELECT b.device, b.ts, CASE WHEN manual < 6 THEN manual ELSE coalesce(set_pos, 5) END AS sp,
                     coalesce(c.on_ticks, 4) AS n, CASE WHEN coalesce(manual, 6) < 6 THEN 'MAN' ELSE 'AUTO' END AS mode,
                     row_number() OVER (PARTITION BY b.device ORDER BY b.ts) - 1 AS k
              FROM both_ b ASOF LEFT JOIN (SELECT device, ts, on_ticks FROM {{commands}} WHERE on_ticks IS NOT NULL) c
                ON b.device = c.device AND b.ts >= c.ts),
    listed AS (SELECT device, k // {_STEP} AS chunk, list(struct_pack(sp := CAST(sp AS BIGINT), n := CAST(n AS BIGINT), o := FALSE,
                      c := CAST(0 AS BIGINT), p := CAST(0 AS BIGINT), got := CAST([] AS BIGINT[])) ORDER BY k) AS l
               FROM ruled GROUP BY ALL),
    run AS (SELECT DISTINCT device, CAST(-1 AS BIGINT) AS chunk, struct_pack(sp := CAST(0 AS BIGINT), n := CAST(0 AS BIGINT), o := TRUE,
                   c := CAST(0 AS BIGINT), p := CAST(5 AS BIGINT), got := CAST([] AS BIGINT[])) AS s FROM listed
            UNION ALL
            SELECT l.device, l.chunk, list_reduce(list_prepend(struct_pack(sp := r.s.sp, n := r.s.n, o := r.s.o, c := r.s.c, p := r.s.p,
                   got := CAST([] AS BIGINT[])), l.l), lambda a, x: struct_pack(sp := x.sp, n := x.n,
                   o := CASE WHEN {_TURNS} THEN NOT a.o WHEN {_FREE} THEN x.sp <> 0 ELSE a.o END,
                   c := CASE WHEN {_TURNS} THEN 1 ELSE a.c + 1 END, p := {_POSITION},
                   got := list_append(a.got, {_POSITION})))
            FROM run r JOIN listed l ON l.device = r.device AND l.chunk = r.chunk + 1),
    turned AS (SELECT device, chunk, unnest(s.got) AS position, generate_subscripts(s.got, 1) - 1 AS i FROM run),
    timeline AS (SELECT u.device, u.ts, CAST(u.sp AS INT) AS set_point, CAST(t.position AS INT) AS position,
                        CAST(t.position * 4095 // 5 AS INT) AS dac, u.mode
                 FROM ruled u JOIN turned t ON u.device = t.device AND u.k = t.chunk * {_STEP} + t.i)
"""


@query("valve_timeline", f"WITH RECURSIVE {_TIMELINE} SELECT * FROM timeline")
def valve_timeline(v: Views):
    """Depends on the whole past tick by tick."""
    return _timeline(v)


_LATCH = """
    WITH pos AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, seq) AS i FROM {valve_log}),
    known AS (SELECT *,
        last_value(CASE WHEN kind = 'error' THEN i END IGNORE NULLS) OVER w AS e,
        last_value(code IGNORE NULLS) OVER w AS c,
        last_value(CASE WHEN kind = 'ack' THEN i END IGNORE NULLS) OVER w AS a,
        last_value(CASE WHEN kind = 'reconnect' THEN i END IGNORE NULLS) OVER w AS r,
        last_value(CASE WHEN kind = 'dac_ok' THEN i END IGNORE NULLS) OVER w AS d
        FROM pos WINDOW w AS (PARTITION BY device ORDER BY i ROWS UNBOUNDED PRECEDING)),
    state AS (SELECT *, e IS NOT NULL AND NOT (coalesce(a > e, FALSE) OR (c = 4 AND coalesce(r > e, FALSE))
                        OR (c = 6 AND coalesce(d > e, FALSE))) AS active FROM known),
    shown AS (SELECT *, CASE WHEN kind = 'tick' AND active THEN c END AS now_code FROM state)
"""
_PUBLISHED = (
    "last_value(now_code IGNORE NULLS) OVER (PARTITION BY device ORDER BY i "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


@query(
    "error_latch",
    _LATCH
    + f"""
    SELECT device, seq, active, CASE WHEN active THEN c END AS error_code,
           CASE WHEN now_code IS NOT NULL THEN {_PUBLISHED} END AS published_code
    FROM shown
    """,
)
def error_latch(v: Views):
    return C.error_latch(v.over_events(VALVE_LOG)).select("device", "seq", "active", "error_code", "published_code")


_TEXTS = " ".join(f"WHEN {code} THEN '{text}'" for code, text in ERROR_TEXTS.items())


@query(
    "error_messages",
    _LATCH
    + f"""
    SELECT device, ts, 'ValveControl/Err' AS topic, CASE p {_TEXTS} ELSE '' END AS payload
    FROM (SELECT *, {_PUBLISHED} AS p FROM shown) WHERE now_code IS NOT NULL
    """,
)
def error_messages(v: Views):
    return C.error_messages(C.error_latch(v.over_events(VALVE_LOG)))


def _measured(name: str) -> str:
    return f"""
    {name}_at AS (SELECT t.device, t.ts, m.{name} FROM timeline t
                  ASOF LEFT JOIN (SELECT device, ts, {name} FROM {{valve_measurements}} WHERE {name} IS NOT NULL) m
                    ON t.device = m.device AND t.ts >= m.ts)"""


@query(
    "valve_report",
    f"""
    WITH RECURSIVE {_TIMELINE}, {_measured('temp_in')}, {_measured('temp_out')}, {_measured('light')},
    rows_ AS (SELECT device, ts, seq, kind, code FROM {{valve_log}} WHERE kind <> 'tick'
              UNION ALL SELECT device, ts, 4611686018427387904 AS seq, 'tick' AS kind, NULL AS code FROM timeline),
    {_LATCH[_LATCH.index('pos AS'):].replace('{valve_log}', 'rows_')},
    failing AS (SELECT device, ts, CASE p {_TEXTS} ELSE '' END AS payload
                FROM (SELECT *, {_PUBLISHED} AS p FROM shown) WHERE now_code IS NOT NULL)
    SELECT device, ts, 'ValveControl/' || name AS topic, payload FROM (
        SELECT device, ts, 'ActPos' AS name, CAST(dac AS STRING) AS payload FROM timeline
        UNION ALL SELECT device, ts, 'Mode', CAST(set_point AS STRING) FROM timeline
        UNION ALL SELECT device, ts, 'ManAuto', mode FROM timeline
        UNION ALL SELECT device, ts, 'TempIn', CAST(CAST(temp_in AS DECIMAL(12, 2)) AS STRING) FROM temp_in_at
        UNION ALL SELECT device, ts, 'TempOut', CAST(CAST(temp_out AS DECIMAL(12, 2)) AS STRING) FROM temp_out_at
        UNION ALL SELECT device, ts, 'Light', CAST(CAST(light AS BIGINT) AS STRING) FROM light_at
        UNION ALL SELECT device, ts, 'Err', payload FROM failing)
    WHERE payload IS NOT NULL
    """,
)
def valve_report(v: Views):
    """Everything a valve publishes at each tick, from its commands, its measurements and its error log."""
    state = C.report_state(_timeline(v), v.over_events(VALVE_MEASUREMENTS), v.over_events(VALVE_LOG))
    return C.valve_report(state)
