"""Valve timeline and error latch against tick-by-tick and row-by-row simulation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hearthline.constants import ERROR_TEXTS
from hearthline.operators import control as C

START = datetime(2024, 1, 1, 0, 0, 30)


def simulate(commands, ticks):
    """What a valve does, one tick after the other."""
    auto, manual, on_ticks = 5, 6, 4
    valve_on, position, count = True, 5, 0
    pending = sorted(commands, key=lambda c: (c[1], c[2]))
    out = []
    for k in range(ticks):
        now = START + timedelta(seconds=60 * k)
        while pending and pending[0][1] <= now:
            _, _, _, set_pos, man, n = pending.pop(0)
            auto = auto if set_pos is None else set_pos
            manual = manual if man is None else man
            on_ticks = on_ticks if n is None else n
        set_point = manual if manual < 6 else auto
        if set_point in (1, 2):
            limit = on_ticks if valve_on or set_point == 2 else 2 * on_ticks
            if count >= limit:
                valve_on = not valve_on
                position = 3 if valve_on else 0
                count = 0
        elif set_point >= 0:
            position = set_point
            valve_on = set_point != 0
        count += 1
        out.append((now, set_point, position))
    return out


def random_commands(seed, n, horizon_s, device=1):
    rng = random.Random(seed)
    commands = []
    for seq in range(n):
        at = START + timedelta(seconds=rng.choice([rng.uniform(0, horizon_s), 60 * rng.randrange(0, horizon_s // 60)]))
        kind = rng.randrange(3)
        commands.append(
            (
                device,
                at,
                seq,
                rng.choice([0, 1, 1, 2, 2, 3, 5, -2]) if kind == 0 else None,
                rng.choice([0, 1, 2, 4, 6, 6]) if kind == 1 else None,
                rng.choice([0, 1, 2, 4, 7, 30, 500, -3]) if kind == 2 else None,
            )
        )
    return commands


@pytest.mark.parametrize("slice_ticks", [1, 17, 400, 14_400])
def test_timeline_equals_simulation(spark, slice_ticks):
    ticks = 1500
    devices = {1: random_commands(1, 60, ticks * 60), 2: random_commands(2, 300, ticks * 60, 2), 3: []}
    rows = [c for cs in devices.values() for c in cs]
    commands = spark.createDataFrame(
        rows, "device int, ts timestamp_ntz, seq bigint, set_pos int, manual int, on_ticks int"
    )
    end = START + timedelta(seconds=60 * (ticks - 1) + 12)
    spans = spark.createDataFrame(
        [(d, START, end) for d in devices], "device int, first_ts timestamp_ntz, last_ts timestamp_ntz"
    )
    timeline = C.valve_timeline(commands, spans, slice_ticks=slice_ticks).collect()
    for device, own in devices.items():
        got = sorted((r["ts"], r["set_point"], r["position"]) for r in timeline if r["device"] == device)
        assert got == simulate(own, ticks)


def test_one_valve_is_spread_over_parts(spark):
    """The maps of slices are composed in three levels, whatever the cut."""
    ticks = 1200
    own = random_commands(9, 150, ticks * 60)
    commands = spark.createDataFrame(own, "device int, ts timestamp_ntz, seq bigint, set_pos int, manual int, on_ticks int")
    end = START + timedelta(seconds=60 * (ticks - 1))
    spans = spark.createDataFrame([(1, START, end)], "device int, first_ts timestamp_ntz, last_ts timestamp_ntz")
    expected = simulate(own, ticks)
    for slice_ticks, part_slices in ((5, 3), (7, 1), (40, 100)):
        timeline = C.valve_timeline(commands, spans, slice_ticks=slice_ticks, part_slices=part_slices).collect()
        assert sorted((r["ts"], r["set_point"], r["position"]) for r in timeline) == expected


def test_ticks_count_from_the_first_command(spark):
    last = START + timedelta(days=3, seconds=59)
    spans = spark.createDataFrame(
        [(1, START, last), (2, START, START), (3, START, START - timedelta(seconds=1)), (4, None, None)],
        "device int, first_ts timestamp_ntz, last_ts timestamp_ntz",
    )
    got = C.minute_ticks(spans, "device").collect()
    assert sorted(r["ts"] for r in got if r["device"] == 1) == [START + timedelta(minutes=k) for k in range(3 * 1440 + 1)]
    assert [r["ts"] for r in got if r["device"] == 2] == [START] and {r["device"] for r in got} == {1, 2}


@pytest.mark.parametrize("width", [1, 50_000_000, 10**13])
def test_manual_from_presses(spark, width):
    rng = random.Random(width)
    rows = []
    for seq in range(600):
        press = rng.choice(["up", "up", "down", "down", "auto", "light", None]) if rng.random() < 0.5 else rng.choice(["up", "down"])
        rows.append((rng.choice([1, 1, 1, 2, None]), START + timedelta(seconds=rng.randrange(0, 400)), seq, press))
    expected = {}
    mode = {}
    for device, _, seq, press in sorted(rows, key=lambda r: (r[1], r[2])):
        m = mode.get(device, 6)
        mode[device] = {"up": min(m + 1, 5), "down": max(m - 1, 0), "auto": 6}.get(press, m)
        expected[seq] = mode[device]
    frame = spark.createDataFrame(rows, "device int, ts timestamp_ntz, seq bigint, press string")
    got = {r["seq"]: r["manual"] for r in C.manual_from_presses(frame, width=width).collect()}
    # presses of no known device come to nothing
    assert got == {seq: expected[seq] for device, _, seq, _ in rows if device is not None}
    assert C.manual_from_presses(frame.limit(0)).count() == 0


def test_report_from_several_logs(spark):
    at = lambda s: START + timedelta(seconds=s)
    timeline = spark.createDataFrame(
        [(1, at(60 * k), 3, 2457, "MAN") for k in range(5)], "device int, ts timestamp_ntz, set_point int, dac int, mode string"
    )
    measured = spark.createDataFrame(
        [(1, at(10), 1, 21.456, None, None), (1, at(60), 2, None, -3.5, None), (1, at(130), 3, 22.0, None, 812.4), (2, at(0), 4, 9.0, 9.0, 9.0)],
        "device int, ts timestamp_ntz, seq bigint, temp_in double, temp_out double, light double",
    )
    log = spark.createDataFrame(
        [(1, at(70), 5, "error", 2), (1, at(80), 6, "tick", None), (1, at(185), 7, "error", 3), (1, at(230), 8, "ack", None)],
        "device int, ts timestamp_ntz, seq bigint, kind string, code int",
    )
    got = {}
    for r in C.valve_report(C.report_state(timeline, measured, log)).collect():
        got.setdefault(int((r["ts"] - START).total_seconds()) // 60, {})[r["topic"].split("/")[1]] = r["payload"]
    always = {"ActPos": "2457", "Mode": "3", "ManAuto": "MAN"}
    assert got[0] == always
    assert got[1] == always | {"TempIn": "21.46", "TempOut": "-3.50"}
    # the text of an error is sent one report late
    assert got[2] == got[1] | {"Err": ""}
    assert got[3] == got[2] | {"TempIn": "22.00", "Light": "812", "Err": ERROR_TEXTS[2]}
    assert got[4] == {k: v for k, v in got[3].items() if k != "Err"}


def test_modes_by_hand(spark):
    """Modes 0, 1, 2, 5, 1 with the interval changed on the way."""
    at = lambda tick: START + timedelta(seconds=60 * tick)
    own = [
        (1, at(0), 0, 0, None, None),
        (1, at(5), 1, 1, None, None),
        (1, at(30), 2, 2, None, None),
        (1, at(40), 3, None, None, 2),
        (1, at(50), 4, 5, None, None),
        (1, at(53), 5, 1, None, None),
    ]
    commands = spark.createDataFrame(
        own, "device int, ts timestamp_ntz, seq bigint, set_pos int, manual int, on_ticks int"
    )
    spans = spark.createDataFrame([(1, START, at(59))], "device int, first_ts timestamp_ntz, last_ts timestamp_ntz")
    timeline = sorted(C.valve_timeline(commands, spans).collect(), key=lambda r: r["ts"])
    assert [(r["ts"], r["set_point"], r["position"]) for r in timeline] == simulate(own, 60)
    # closed; after eight ticks off the valve opens for four
    assert [r["position"] for r in timeline[:14]] == [0] * 8 + [3] * 4 + [0] * 2
    assert timeline[52]["dac"] == 4095 and timeline[52]["mode"] == "AUTO"


def test_manual_override(spark):
    commands = spark.createDataFrame(
        [(1, START, 0, 4, None), (1, START + timedelta(seconds=100), 1, None, 3), (1, START + timedelta(seconds=200), 2, None, 6)],
        "device int, ts timestamp_ntz, seq bigint, set_pos int, manual int",
    )
    ticks = spark.createDataFrame(
        [(1, START + timedelta(seconds=60 * k)) for k in range(6)], "device int, ts timestamp_ntz"
    )
    got = sorted(C.effective_setpoint(ticks, commands).collect(), key=lambda r: r["ts"])
    assert [r["set_point"] for r in got] == [4, 4, 3, 3, 4, 4]
    assert [r["mode"] for r in got] == ["AUTO", "AUTO", "MAN", "MAN", "AUTO", "AUTO"]


def test_asof_takes_a_setting_of_the_same_instant(spark):
    settings = spark.createDataFrame([(1, START, 7, 2)], "device int, ts timestamp_ntz, seq bigint, set_pos int")
    ticks = spark.createDataFrame(
        [(1, START - timedelta(microseconds=1)), (1, START)], "device int, ts timestamp_ntz"
    )
    got = sorted(C.asof(ticks, settings, ["device"], ["set_pos"]).collect(), key=lambda r: r["ts"])
    assert [r["set_pos"] for r in got] == [None, 2]


def latch(rows):
    active, code, last_text, out = False, None, None, []
    for _, _, seq, kind, new_code in sorted(rows, key=lambda r: (r[1], r[2])):
        published = None
        if kind == "error":
            active, code = True, new_code
        elif kind == "ack":
            active = False
        elif kind == "reconnect" and code == 4:
            active = False
        elif kind == "dac_ok" and code == 6:
            active = False
        elif kind == "tick" and active:
            published, last_text = last_text, code
        out.append((seq, active, code if active else None, published))
    return sorted(out)


@pytest.mark.parametrize("width", [60_000_000, 10**12])
def test_error_latch(spark, width):
    rng = random.Random(3)
    rows = []
    for seq in range(400):
        kind = rng.choice(["error", "ack", "reconnect", "dac_ok", "tick", "tick", "tick"])
        code = rng.randrange(1, 7) if kind == "error" else None
        rows.append((1, START + timedelta(seconds=rng.randrange(0, 90_000)), seq, kind, code))
    log = spark.createDataFrame(rows, "device int, ts timestamp_ntz, seq bigint, kind string, code int")
    got = C.error_latch(log, width=width).collect()
    assert sorted((r["seq"], r["active"], r["error_code"], r["published_code"]) for r in got) == latch(rows)


def test_report_topics(spark):
    timeline = spark.sql("SELECT 1 AS device, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 3 AS set_point, 2457 AS dac, 'MAN' AS mode")
    got = {r["topic"]: r["payload"] for r in C.valve_report(timeline).collect()}
    assert got == {"ValveControl/ActPos": "2457", "ValveControl/Mode": "3", "ValveControl/ManAuto": "MAN"}
