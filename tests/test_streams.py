"""Streams against batch on the same rows, and files as sources and sinks."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import ingest as I
from hearthline.operators.control import effective_setpoint
from hearthline.operators.health import silence_gaps
from hearthline.operators.rollup import rollup
from hearthline.sources import messages as M
from hearthline.sources.points_store import read_points
from hearthline.streaming import jobs

T0 = datetime(2024, 1, 1)


def late_points(spark, rows):
    schema = "tier string, measurement string, time timestamp, field string, value double, write_seq bigint"
    return spark.createDataFrame(
        [("t", "m", T0 + timedelta(minutes=m), "f", float(v), i) for i, (m, v) in enumerate(rows)], schema
    )


def test_late_points(spark, tmp_path):
    """Two hours late counts, more is dropped."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([(0, 1), (150, 1)], [(40, 3), (100, 9), (400, 1)], [(200, 100), (1000, 1)], [(5000, 0)]):
        frame = late_points(spark, rows)
        frame.write.mode("append").parquet(source)
        stream = jobs.rollup_stream(spark.readStream.schema(frame.schema).parquet(source), "mean", 3600)
        jobs.run_available(stream, out, checkpoint)
    got = {r["time"]: r["value"] for r in jobs.read_output(spark, stream, out).collect()}
    hour = lambda h: T0 + timedelta(hours=h)
    # minute 40 came while hour 0 was still open; minute 200 came after hour 3 was closed
    assert got == {hour(0): 2.0, hour(1): 9.0, hour(2): 1.0, hour(6): 1.0, hour(16): 1.0}


def test_late_points_rewrite_a_tier(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "points", "checkpoint"))
    seen = []
    for rows in ([(0, 1), (30, 3), (61, 7)], [(50, 5), (200, 1)], [(10, 100)]):
        frame = late_points(spark, rows)
        frame.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(frame.schema).parquet(source)
        jobs.run_into_tier(jobs.rollup_stream(arriving, "mean", 3600), root, "one_year", checkpoint)
        stored = read_points(spark, root).where(F.col("tier") == "one_year").collect()
        seen.append({r["time"].hour: r["value"] for r in stored})
    # minute 50 came in time, minute 10 two hours after hour 0 had been closed
    assert seen == [{0: 2.0, 1: 7.0}, {0: 3.0, 1: 7.0, 3: 1.0}, {0: 3.0, 1: 7.0, 3: 1.0}]


def test_stream_equals_batch_once_closed(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(m, m % 7) for m in range(0, 600, 3)] + [(10_000, 0)]
    frame = late_points(spark, rows)
    frame.write.parquet(source)
    stream = jobs.rollup_stream(spark.readStream.schema(frame.schema).parquet(source), "mean", 300)
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted(map(tuple, jobs.read_output(spark, stream, str(tmp_path / "out")).collect()))
    batch = sorted(map(tuple, rollup(frame.where("value IS NOT NULL AND write_seq < 200"), "mean", 300).collect()))
    assert got == batch


def test_silence_alarms_match_batch_gaps(spark, tmp_path):
    seconds = [0, 100, 280, 461, 500, 2000, 2180, 9000, 90_000]
    rows = [(c, 1 if c != 3 else 0, T0 + timedelta(seconds=s), i) for c in (1, 2, 3) for i, s in enumerate(seconds)]
    frame = spark.createDataFrame(rows, "channel int, caps int, ts timestamp, seq bigint")
    frame.write.parquet(str(tmp_path / "in"))
    jobs.combine_sessions_early(spark)
    stream = jobs.silence_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 180)
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    alarms = jobs.read_output(spark, stream, str(tmp_path / "out"))
    got = sorted((r["channel"], r["silent_from"]) for r in alarms.collect())
    gaps = silence_gaps(frame.where("caps <> 0"), 180).collect()
    # every closed gap raised an alarm; the last reading's session is still open
    assert got == sorted((r["channel"], r["silent_from"]) for r in gaps)
    assert {r["topic"] for r in alarms.collect()} == {"Sensor1/Err", "Sensor2/Err"}


def alarms_by_hand(times, limit, every, until):
    """Alarms and clearing rows of one sensor, seconds since the start."""
    out = []
    for at, following in zip(times, [*times[1:], None]):
        end = until if following is None else following
        if end - at > limit:
            out += [(t, "1") for t in range(at + limit, end + 1, every)]
            if following is not None:
                out.append((following, "0"))
    return sorted(out)


def test_alarms_repeat_until_the_next_reading(spark, tmp_path):
    """Several runs, readings out of order within and between them, and the end of the log."""
    seconds = {1: [0, 100, 281, 300, 2000, 2180, 9000, 9100], 2: [50, 3000], 3: [10]}
    arrivals = [
        [(1, 281), (1, 0), (1, 100), (2, 50), (3, 10)],
        [(1, 2180), (2, 3000)],
        [(1, 2000), (1, 300)],  # 300 is too late for its hour, 2000 is not
        [(1, 9100), (1, 9000)],
    ]
    schema = "channel int, caps int, ts timestamp"
    source, out, work = (str(tmp_path / n) for n in ("in", "out", "work"))
    late = lambda r: jobs.alarm_stream(r, 180, 600, "30 minutes")
    for k, rows in enumerate(arrivals):
        made = [(c, 1, T0 + timedelta(seconds=s)) for c, s in rows] + [(9, 0, T0 + timedelta(seconds=rows[0][1]))]
        spark.createDataFrame(made, schema).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        if k < len(arrivals) - 1:
            jobs.run_open(late, arriving, out, work)
    until = 12_000
    stream = jobs.run_to_end(late, arriving, "ts", out, work, until=T0 + timedelta(seconds=until + 1800), marker={"caps": 1})
    found = jobs.read_output(spark, stream, out).collect()
    for channel, own in seconds.items():
        got = sorted((int((r["ts"] - T0).total_seconds()), r["payload"]) for r in found if r["channel"] == channel)
        expected = own if channel != 1 else [s for s in own if s != 300]
        # 300 came behind the watermark
        assert got == alarms_by_hand(expected, 180, 600, until), channel
    assert {r["topic"] for r in found} == {"Sensor1/Err", "Sensor2/Err", "Sensor3/Err"}


def test_alarms_of_a_watermark_inside_a_stretch(spark, tmp_path):
    """Readings come in many runs; the watermark often lies between readings that belong together."""
    rng = random.Random(11)
    times, at = [], 0
    while at < 20_000:
        at += rng.choice([20, 60, 100, 150, 179, 180, 181, 700, 2500]) if rng.random() < 0.4 else rng.randrange(1, 120)
        times.append(at)
    schema = "channel int, caps int, ts timestamp"
    source, out, work = (str(tmp_path / n) for n in ("in", "out", "work"))
    transform = lambda r: jobs.alarm_stream(r, 180, 600, "300 seconds")
    cuts = [0, *sorted(rng.sample(range(1, len(times)), 4)), len(times)]
    arrivals = [times[a:b] for a, b in zip(cuts, cuts[1:])]
    for before, after in zip(arrivals, arrivals[1:]):  # some readings come a run late, but not too late
        moved = [t for t in before if t > before[-1] - 250 and rng.random() < 0.5 and t != before[-1]]
        before[:], after[:] = [t for t in before if t not in moved], moved + after
    for k, own in enumerate(arrivals):
        spark.createDataFrame([(1, 1, T0 + timedelta(seconds=t)) for t in own], schema).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        if k < len(arrivals) - 1:
            jobs.run_open(transform, arriving, out, work)
    until = times[-1] + 3000
    stream = jobs.run_to_end(transform, arriving, "ts", out, work, until=T0 + timedelta(seconds=until + 300), marker={"caps": 1})
    got = sorted((int((r["ts"] - T0).total_seconds()), r["payload"]) for r in jobs.read_output(spark, stream, out).collect())
    assert got == alarms_by_hand(times, 180, 600, until) and len(got) > 30


def test_frames_cut_between_runs(spark, tmp_path):
    """A log cut at random bytes, some cuts between triggers, gives the frames of the whole log."""
    rng = random.Random(5)
    parts, runs = [], []
    for port in (1, 2):
        text = "".join(rng.choice(["%{a}$", "%", "$", "noise", "%long " + "x" * 40 + "$", "%%$", "%\n$", "é"]) for _ in range(200))
        cuts = sorted(rng.sample(range(1, len(text)), 60))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
            parts.append((port, 2 * k + port, text[a:b]))
            runs.append(k // 16)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "port int, seq bigint, text string"
    for run in range(4):
        rows = [p for p, r in zip(parts, runs) if r == run]
        rng.shuffle(rows)
        spark.createDataFrame([*rows, (1, 0, None)], schema).write.mode("append").parquet(source)
        stream = jobs.frame_stream(spark.readStream.schema(schema).parquet(source))
        jobs.run_available(stream, out, checkpoint)
    got = sorted(map(tuple, jobs.read_output(spark, stream, out).collect()))
    log = spark.createDataFrame(parts, schema)
    batch = I.split_frames_across_rows(log, ["port"], F.col("seq"), width=10).select("port", "seq", "payload")
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 100


@pytest.mark.parametrize("width", [1, 16, 1 << 16])
def test_frames_of_slices_and_their_edges(spark, tmp_path, width):
    """Slices of any width, with empty texts, repeated numbers, ports without markers and a null port, give the same frames."""
    rng = random.Random(9)
    parts = []
    for port in (1, 2, None):
        for k in range(240):
            text = "".join(rng.choice(["%{a}$", "%", "$", "n", "%%$", "%\n$", "é", ""]) for _ in range(rng.randrange(4)))
            parts += [(port, 3 * k, text)] * rng.choice([1, 1, 1, 2])
        parts.append((port, None, None))
    parts += [(3, k, "%x") for k in range(50)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "port int, seq bigint, text string"
    for low, high in ((-1, 200), (200, 421), (421, 1000)):
        rows = [p for p in parts if low <= (-1 if p[1] is None else p[1]) < high]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = jobs.frame_stream(spark.readStream.schema(schema).parquet(source), width=width)
        jobs.run_available(stream, out, checkpoint)
    got = [tuple(r) for r in jobs.read_output(spark, stream, out).collect()]
    expected = []
    for port in (1, 2, None):
        own = sorted((p for p in parts if p[0] == port and p[2] is not None), key=lambda p: p[1])
        text, ends = "", []
        for _, seq, piece in own:
            text += piece
            ends.append((len(text), seq))
        expected += [(port, next(q for e, q in ends if e >= m.end()), m[1]) for m in re.finditer(r"%([^$]*)\$", text)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(expected, key=order) and len(got) > 200


def test_set_points_of_two_streams(spark, tmp_path):
    rng = random.Random(6)
    at = lambda s: T0 + timedelta(seconds=s)
    commands = [
        (rng.choice([1, 2]), at(rng.randrange(0, 3000)), k, rng.choice([None, 0, 3, 5]), rng.choice([None, None, 2, 6])) for k in range(80)
    ]
    ticks = [(d, at(60 * k)) for d in (1, 2, 3) for k in range(50)]
    command_schema, tick_schema = "device int, ts timestamp, seq bigint, set_pos int, manual int", "device int, ts timestamp"
    folders = [str(tmp_path / n) for n in ("commands", "ticks", "out", "work")]
    for low, high in ((0, 1000), (1000, 2000), (2000, 4000)):  # three runs, out of order inside each
        within = lambda r: low <= (r[1] - T0).total_seconds() < high  # noqa: B023, E731
        spark.createDataFrame(list(filter(within, commands)), command_schema).write.mode("append").parquet(folders[0])
        spark.createDataFrame(list(filter(within, ticks)), tick_schema).write.mode("append").parquet(folders[1])
        arriving = spark.readStream.schema(tick_schema).parquet(folders[1])
        transform = lambda c: jobs.effective_stream(arriving, c)  # noqa: B023, E731
        source = spark.readStream.schema(command_schema).parquet(folders[0])
        if high < 4000:
            jobs.run_open(transform, source, folders[2], folders[3])
    stream = jobs.run_to_end(transform, source, "ts", folders[2], folders[3])
    got = sorted(map(tuple, jobs.read_output(spark, stream, folders[2]).collect()))
    batch = effective_setpoint(spark.createDataFrame(ticks, tick_schema), spark.createDataFrame(commands, command_schema))
    assert got == sorted(map(tuple, batch.select("device", "ts", "set_point", "mode").collect())) and len(got) == 150


def test_end_of_a_source_gives_open_windows(spark, tmp_path):
    rows = [(m, m % 7) for m in range(0, 600, 3)]
    frame = late_points(spark, rows)
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = jobs.run_to_end(lambda p: jobs.rollup_stream(p, "mean", 300), source, "time", out, str(tmp_path / "work"))
    got = sorted(map(tuple, jobs.read_output(spark, stream, out).collect()))
    assert got == sorted(map(tuple, rollup(frame, "mean", 300).collect()))


def test_an_empty_source_ends(spark, tmp_path):
    frame = late_points(spark, [(0, 1)]).limit(0)
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = jobs.run_to_end(lambda p: jobs.rollup_stream(p, "mean", 300), source, "time", out, str(tmp_path / "work"))
    assert jobs.read_output(spark, stream, out).count() == 0


def test_sampling_stream(spark, tmp_path):
    rows = [(1, T0 + timedelta(seconds=s), i, 10 * s) for i, s in enumerate([0, 5, 14, 15, 40, 600])]
    frame = spark.createDataFrame(rows, "channel int, ts timestamp, seq bigint, iTempA int")
    frame.write.parquet(str(tmp_path / "in"))
    stream = jobs.sample_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = jobs.read_output(spark, stream, str(tmp_path / "out")).collect()
    at = lambda s: T0 + timedelta(seconds=s)
    assert sorted((r["sent_at"], r["iTempA"]) for r in got) == [(at(15), 140), (at(30), 150), (at(45), 400)]


def test_message_log_round_trip(spark, tmp_path):
    folder = str(tmp_path / "log")
    messages = spark.createDataFrame(
        [(T0, "Sensor1/fTempA", "21.050", 1), (T0, "ValveControl/SetPos", " 4x", 2)],
        "ts timestamp, topic string, payload string, seq bigint",
    )
    M.write_messages(messages, folder)
    stored = M.read_messages(spark, folder)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, messages.collect()))
    routed = I.route_messages(M.stream_messages(spark, folder)).select("topic", "set_pos")
    jobs.run_available(routed, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = jobs.read_output(spark, routed, str(tmp_path / "out")).where(F.col("set_pos").isNotNull()).collect()
    assert [(r["topic"], r["set_pos"]) for r in got] == [("ValveControl/SetPos", 4)]


def test_text_log_to_points(spark, tmp_path):
    folder = str(tmp_path / "serial")
    lines = ['xx%{"sensor":1,"time":1,"SensCap":1,"iTempA":2100,"iCSum":2101}$yy', '%{"sensor":1,"SensCap":1,"iTempA":1']
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(folder)
    log = M.read_text_log(spark, folder).withColumns({"seq": F.lit(1), "ts": F.lit(T0)})
    assert [(p["measurement"], p["field"], p["value"]) for p in I.frames_to_points(log).collect()] == [
        ("sSens1", "fTempA", 21.0)
    ]
