"""Streaming queries, each run over all that there is."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.constants import STALE_BRIDGE_S
from hearthline.operators.control import minute_ticks
from hearthline.operators.ingest import frames_to_points
from hearthline.plans.registry import CHECKS, query
from hearthline.plans.rollups import DIGITS, rounded
from hearthline.plans.views import COMMANDS, FRAMES, POINTS, READINGS, Views
from hearthline.session import work_dir
from hearthline.sources.points_store import read_points
from hearthline.sources.tables import event_time
from hearthline.streaming import jobs


def _without_zone(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _run_to_end(v: Views, name: str, source: DataFrame, time: str, transform, **options) -> DataFrame:
    folder = work_dir(v.spark, name)
    stream = jobs.run_to_end(transform, source, time, f"{folder}/out", folder, **options)
    return _without_zone(jobs.read_output(v.spark, stream, f"{folder}/out"))


def _run(v: Views, name: str, stream: DataFrame) -> DataFrame:
    folder = work_dir(v.spark, name)
    jobs.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return _without_zone(jobs.read_output(v.spark, stream, f"{folder}/out"))


@query(
    "stream_rollup",
    f"""
    SELECT tier, measurement, field, time_bucket(INTERVAL '1 hour', time) AS time, round(avg(value), {DIGITS}) AS value
    FROM {{points}} GROUP BY ALL
    """,
)
def stream_rollup(v: Views):
    points = v.stream(POINTS, "time")
    return rounded(_run_to_end(v, "stream_rollup", points, "time", lambda p: jobs.rollup_stream(p, "mean", 3600)))


@query(
    "stream_into_tier",
    f"""
    SELECT 'forever' AS tier, measurement, time_bucket(INTERVAL '1 hour', time) AS time, field,
           round(avg(value), {DIGITS}) AS value
    FROM {{points}} GROUP BY ALL
    """,
)
def stream_into_tier(v: Views):
    """A rollup that keeps a tier of the store up to date, open buckets included."""
    folder = work_dir(v.spark, "stream_into_tier")
    stream = jobs.rollup_stream(v.stream(POINTS, "time"), "mean", 3600, by=("measurement", "field"))
    jobs.run_into_tier(stream, f"{folder}/points", "forever", f"{folder}/checkpoint")
    return rounded(read_points(v.spark, f"{folder}/points").drop("write_seq"))


@query("stream_ingest", CHECKS["frames_to_points"])
def stream_ingest(v: Views):
    """The way from serial text to stored points as a stream."""
    readings = v.stream(READINGS, "ts")
    frames = readings.selectExpr(*[f"{expr} AS {name}" for name, expr in FRAMES.items()])
    return _run(v, "stream_ingest", frames_to_points(frames))


@query(
    "stream_sample_15s",
    f"""
    SELECT channel, sent_at, ts, seq, caps, iTempA AS "iTempA" FROM (
        SELECT *, time_bucket(INTERVAL '15 seconds', ts) + INTERVAL '15 seconds' AS sent_at,
               row_number() OVER (PARTITION BY channel, time_bucket(INTERVAL '15 seconds', ts)
                                  ORDER BY ts DESC, seq DESC) AS rn FROM {{readings}})
    WHERE rn = 1
    """,
)
def stream_sample_15s(v: Views):
    readings = v.stream(READINGS, "ts").select("seq", "ts", "channel", "caps", "iTempA")
    return _run_to_end(v, "stream_sample_15s", readings, "ts", jobs.sample_stream)


@query(
    "stream_silence",
    f"""
    WITH linked AS (SELECT channel, ts, lag(ts) OVER w AS p, lead(ts) OVER w AS n FROM {{readings}} WHERE caps <> 0
                    WINDOW w AS (PARTITION BY channel ORDER BY ts, seq)),
    marked AS (SELECT *, CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {STALE_BRIDGE_S} * 1000000 THEN 1 ELSE 0 END
                      AS opens FROM linked),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session
                 FROM marked)
    SELECT channel, min(ts) AS heard_from, max(ts) AS silent_from,
           max(ts) + INTERVAL '{STALE_BRIDGE_S} seconds' AS alarm_at, count(*) AS readings,
           'Sensor' || CAST(channel AS STRING) || '/Err' AS topic, '1' AS payload
    FROM numbered GROUP BY channel, session
    """,
)
def stream_silence(v: Views):
    jobs.combine_sessions_early(v.spark)
    # the row that ends the log has a capability, so that it passes the gate, and no sensor
    return _run_to_end(
        v, "stream_silence", v.stream(READINGS, "ts"), "ts", lambda r: jobs.silence_stream(r, STALE_BRIDGE_S), marker={"caps": 1}
    )


_ALARM_EVERY_S = 600


@query(
    "stream_alarms",
    f"""
    WITH heard AS (SELECT channel, ts, lead(ts) OVER (PARTITION BY channel ORDER BY ts, seq) AS n FROM {{readings}} WHERE caps <> 0),
    silent AS (SELECT channel, ts AS silent_from, n AS silent_to, coalesce(n, date_trunc('milliseconds',
                      (SELECT max(ts) FROM events) + INTERVAL '1 hour')) AS until FROM heard),
    gaps AS (SELECT * FROM silent WHERE epoch_us(until) - epoch_us(silent_from) > {STALE_BRIDGE_S} * 1000000)
    SELECT channel, unnest(generate_series(silent_from + INTERVAL '{STALE_BRIDGE_S} seconds', until,
           INTERVAL '{_ALARM_EVERY_S} seconds')) AS ts, 'Sensor' || CAST(channel AS STRING) || '/Err' AS topic, '1' AS payload
    FROM gaps
    UNION ALL
    SELECT channel, silent_to AS ts, 'Sensor' || CAST(channel AS STRING) || '/Err' AS topic, '0' AS payload
    FROM gaps WHERE silent_to IS NOT NULL
    """,
)
def stream_alarms(v: Views):
    """Alarms as they fall due, up to an hour after the newest reading."""
    late_s = 600
    newest = v.events.agg(F.max("ts").alias("ts")).first()["ts"] or datetime(2000, 1, 1)
    until = newest + timedelta(hours=1, seconds=late_s)
    return _run_to_end(
        v,
        "stream_alarms",
        v.stream(READINGS, "ts").select("channel", "caps", "ts"),
        "ts",
        lambda r: jobs.alarm_stream(r, STALE_BRIDGE_S, _ALARM_EVERY_S, f"{late_s} seconds"),
        until=until,
        marker={"caps": 1},
    )


@query(
    "stream_setpoint",
    """
    SELECT device, max(ts) AS ts, CASE WHEN max(m) < 6 THEN max(m) ELSE coalesce(max(s), 5) END AS set_point FROM (
        SELECT device, ts, first_value(manual IGNORE NULLS) OVER w AS m, first_value(set_pos IGNORE NULLS) OVER w AS s
        FROM {commands}
        WINDOW w AS (PARTITION BY device ORDER BY ts DESC, seq DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    GROUP BY device
    """,
)
def stream_setpoint(v: Views):
    """The set-points in force after all commands have arrived."""
    folder = work_dir(v.spark, "stream_setpoint")
    stream = jobs.setpoint_stream(v.stream(COMMANDS, "ts"))
    jobs.run_changes(stream, f"{folder}/out", f"{folder}/checkpoint")
    return _without_zone(jobs.read_state(v.spark, stream, f"{folder}/out", "device"))


# Every thirteenth point arrives a run late; a run brings half of the points.
_RUNS = 3
_ARRIVAL = (
    "CAST(floor(2 * write_seq / ((SELECT max(event_id) FROM events) + 1)) AS INT) "
    "+ CASE WHEN write_seq % 13 = 0 THEN 1 ELSE 0 END"
)


@query(
    "stream_late",
    f"""
    WITH arrived AS (SELECT *, {_ARRIVAL.replace('2 * write_seq /', 'CAST(2 * write_seq AS DOUBLE) /')} AS run,
                            time_bucket(INTERVAL '1 hour', time) + INTERVAL '1 hour' AS bucket_end FROM {{points}}),
    marks AS (SELECT run, max(max(time)) OVER (ORDER BY run) AS newest FROM arrived GROUP BY run),
    kept AS (SELECT a.* FROM arrived a LEFT JOIN marks m ON m.run = a.run - 1
             WHERE m.run IS NULL OR a.bucket_end > date_trunc('milliseconds', m.newest) - INTERVAL '2 hours')
    SELECT tier, measurement, field, bucket_end - INTERVAL '1 hour' AS time, round(avg(value), {DIGITS}) AS value
    FROM kept GROUP BY ALL
    """,
)
def stream_late(v: Views):
    """Points arrive in several runs, some of them late: those up to two hours late count, later ones are dropped."""
    folder = work_dir(v.spark, "stream_late")
    newest_id = v.events.agg(F.max("event_id")).first()[0]
    arrival = F.floor(F.col("write_seq") * 2 / (newest_id + 1)) + F.when(F.col("write_seq") % 13 == 0, 1).otherwise(0)
    points = event_time(v.points, "time").withColumn("run", arrival)
    arriving = v.spark.readStream.schema(points.drop("run").schema).parquet
    hourly = lambda p: jobs.rollup_stream(p, "mean", 3600, late="2 hours")
    for run in range(_RUNS):
        points.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{folder}/in")
        if run < _RUNS - 1:
            jobs.run_open(hourly, arriving(f"{folder}/in"), f"{folder}/out", folder)
    stream = jobs.run_to_end(hourly, arriving(f"{folder}/in"), "time", f"{folder}/out", folder)
    return rounded(_without_zone(jobs.read_output(v.spark, stream, f"{folder}/out")))


# A port's log in three runs; each cut lies inside a frame.
_PART_RUN = "CASE WHEN seq <= {0} THEN 0 WHEN seq <= 2 * {0} THEN 1 ELSE 2 END"


@query("stream_frames", CHECKS["split_frames_across_rows"])
def stream_frames(v: Views):
    """Frames of a serial log that comes in several runs and pieces."""
    folder = work_dir(v.spark, "stream_frames")
    newest_id = v.events.agg(F.max("event_id")).first()[0] or 0
    parts = v.frame_parts.select("port", "seq", "text")
    # even numbers are the first halves of frames
    runs = parts.withColumn("run", F.expr(_PART_RUN.format(2 * (newest_id // 3))))
    for run in range(3):
        runs.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.frame_stream(v.spark.readStream.schema(parts.schema).parquet(f"{folder}/in"))
        jobs.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return jobs.read_output(v.spark, stream, f"{folder}/out").drop("seq")


@query("stream_effective", CHECKS["effective_setpoint"])
def stream_effective(v: Views):
    """Set-points in force at every tick, from a stream of ticks and one of commands."""
    folder = work_dir(v.spark, "stream_effective")
    commands = v.over_events(COMMANDS)
    spans = commands.groupBy("device").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    ticks = event_time(minute_ticks(spans, "device"), "ts")
    ticks.write.parquet(f"{folder}/ticks")
    arriving = v.spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks")

    def transform(rows: DataFrame) -> DataFrame:
        return jobs.effective_stream(arriving, rows)

    stream = jobs.run_to_end(transform, v.stream(COMMANDS, "ts"), "ts", f"{folder}/out", folder)
    return _without_zone(jobs.read_output(v.spark, stream, f"{folder}/out"))
