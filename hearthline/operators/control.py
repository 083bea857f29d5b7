"""Valve control: set-points in force, duty-cycle timeline, error latch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.constants import (
    AUTO_MODE,
    DEFAULT_ON_TICKS,
    DEFAULT_SET_POINT,
    ERR_CLEARED_BY_DAC,
    ERR_CLEARED_BY_RECONNECT,
    ERROR_TEXTS,
    MAX_POSITION,
    PULSE_POSITION,
    TICK_S,
)
from hearthline.functions.scalar import dac_value, fixed_decimals, mode_label
from hearthline.operators.ordered import HOUR_US, carry_last, micros, order_key
from hearthline.session import cut_lineage, spread

# Ticks sort after everything that was received at the same instant.
_AFTER = 2**62


def asof(
    ticks: DataFrame, settings: DataFrame, keys: list[str], values: list[str], width: int = HOUR_US
) -> DataFrame:
    """At each tick (keys, ts) the last setting (keys, ts, seq, values) received at or before it.

    Ticks and settings are merged and each value is carried forward, so there is no range join.
    """
    merged = settings.select(*keys, "ts", "seq", *values).unionByName(
        ticks.withColumn("seq", F.lit(_AFTER)), allowMissingColumns=True
    )
    carried = carry_last(
        merged,
        keys,
        micros(F.col("ts")),
        F.col("seq"),
        {f"_now_{v}": F.col(v) for v in values},
        width=width,
    )
    at_ticks = carried.where(F.col("seq") == _AFTER)
    return at_ticks.select(*ticks.columns, *[F.col(f"_now_{v}").alias(v) for v in values])


def minute_ticks(spans: DataFrame, key: str, tick_s: int = TICK_S) -> DataFrame:
    """A row per device and tick from ``first_ts`` to ``last_ts``, counted from ``first_ts``; first by day, then within it."""
    day = 86_400 // tick_s
    ticks = F.floor((micros(F.col("last_ts")) - micros(F.col("first_ts"))) / F.lit(tick_s * 1_000_000)) + 1
    bounded = spans.select(key, "first_ts", ticks.alias("_n")).where("_n > 0")
    runs = bounded.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / day).cast("int"))).alias("_day"))
    first = F.col("_day").cast("bigint") * day
    last = F.least(first + day, F.col("_n")) - 1
    return (
        spread(runs, key, "_day")
        .select("*", F.explode(F.sequence(first, last)).alias("_k"))
        .select(key, (F.col("first_ts") + F.make_dt_interval(secs=F.col("_k") * tick_s)).alias("ts"))
    )


def set_point_in_force(manual: Column, remote: Column) -> Column:
    """A manual position overrides; mode 6, or no manual action yet, takes the last remote value."""
    automatic = F.coalesce(remote, F.lit(DEFAULT_SET_POINT))
    return F.when(manual < AUTO_MODE, manual).otherwise(automatic)


def effective_setpoint(ticks: DataFrame, commands: DataFrame, key: str = "device", **options) -> DataFrame:
    """Set-point and mode at each tick, from commands (device, ts, seq, set_pos, manual)."""
    now = asof(ticks, commands, [key], ["set_pos", "manual"], **options)
    return now.withColumn("set_point", set_point_in_force(F.col("manual"), F.col("set_pos"))).withColumn(
        "mode", mode_label(F.coalesce("manual", F.lit(AUTO_MODE)))
    )


# ---- key presses ----------------------------------------------------------------------------------------------
#
# A key adds one up to 5, takes one away down to 0, or sets 6 (automatic). Each is a function x -> min(max(x + add, lo), hi),
# and so is each composition of them: (add, lo, hi) of many presses is one value. Slices of a device's presses are reduced to
# one each, these to one per block of slices, and those are run through in order, which gives the mode that each block, each
# slice and each press starts from. No level holds more than a block.

#: Slices in a block: a quarter year of hours.
BLOCK_SLICES = 2048
_PRESSES = {"up": (1, 0, MAX_POSITION), "down": (-1, 0, AUTO_MODE), "auto": (0, AUTO_MODE, AUTO_MODE)}


def _clamp(x: Column, m: Column) -> Column:
    return F.least(F.greatest(x + m["add"], m["lo"]), m["hi"])


def _then(a: Column, b: Column) -> Column:
    """The function that does ``a`` first and then ``b``."""
    within = lambda x: F.least(F.greatest(x + b["add"], b["lo"]), b["hi"])
    return F.struct((a["add"] + b["add"]).alias("add"), within(a["lo"]).alias("lo"), within(a["hi"]).alias("hi"))


def _function(add: Column, lo: Column, hi: Column) -> Column:
    return F.struct(add.cast("bigint").alias("add"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def _in_order(df: DataFrame, keys: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """One row per key with ``m``, its functions in order, as an array of (order, carried, m)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *carried, "m"))).alias("own"))


def _composed(own: Column) -> Column:
    same = _function(F.lit(0), F.lit(0), F.lit(AUTO_MODE))
    return F.aggregate(own, same, lambda done, x: _then(done, x["m"]))


def _run_through(start: Column, own: Column) -> Column:
    """The mode before each of the functions, as an array beside them, and after the last one."""
    first = F.struct(start.alias("mode"), F.array().cast("array<bigint>").alias("before"))
    step = lambda done, x: F.struct(_clamp(done["mode"], x["m"]).alias("mode"), F.concat(done["before"], F.array(done["mode"])).alias("before"))
    return F.aggregate(own, first, step)


def manual_from_presses(presses: DataFrame, key: str = "device", start: int = AUTO_MODE, width: int = HOUR_US) -> DataFrame:
    """``manual``, the mode after each press of (device, ts, seq, press); ``press`` is up, down or auto.

    At 5 and at 6 up gives 5, at 0 down gives 0. A press of another name changes nothing. ``width`` of a slice in microseconds
    changes how the work is cut, never the result; presses of one device within one slice share a task.
    """
    add, lo, hi = (F.lit(0), F.lit(0), F.lit(AUTO_MODE))
    for name, (a, low, high) in _PRESSES.items():
        named = F.col("press") == name
        add, lo, hi = F.when(named, a).otherwise(add), F.when(named, low).otherwise(lo), F.when(named, high).otherwise(hi)
    at = micros(F.col("ts"))
    rows = presses.select(key, "ts", "seq", "press", _function(add, lo, hi).alias("m"), F.floor(at / F.lit(width)).alias("slice"))
    rows = rows.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
    slices = _in_order(rows, [key, "block", "slice"], ["ts", "seq"], ["press"])
    of_slices = slices.select(key, "block", "slice", _composed(F.col("own")).alias("m"))
    blocks = _in_order(of_slices, [key, "block"], ["slice"], [])
    of_blocks = _in_order(blocks.select(key, "block", _composed(F.col("own")).alias("m")), [key], ["block"], [])
    mode = F.lit(start).cast("bigint")
    zipped = lambda own, begin: F.explode(F.arrays_zip(own.alias("own"), _run_through(begin, own)["before"].alias("before")))
    starts = of_blocks.select(key, zipped(F.col("own"), mode).alias("x")).select(key, F.col("x.own.block").alias("block"), F.col("x.before").alias("begin"))
    begun = blocks.join(starts, [key, "block"]).select(key, "block", zipped(F.col("own"), F.col("begin")).alias("x"))
    begun = begun.select(key, "block", F.col("x.own.slice").alias("slice"), F.col("x.before").alias("begin"))
    # inside a slice each press knows the mode before it
    out = slices.join(begun, [key, "block", "slice"]).select(key, zipped(F.col("own"), F.col("begin")).alias("x"))
    x = F.col("x.own")
    return out.select(key, x["ts"].alias("ts"), x["seq"].alias("seq"), x["press"].alias("press"), _clamp(F.col("x.before"), x["m"]).cast("int").alias("manual"))


# ---- duty cycle -----------------------------------------------------------------------------------------------
#
# The tick counter runs on across set-point changes, so the state at a tick depends on the whole past of the device.
# A segment is a run of ticks under one set-point; its end state follows from its start state by a formula. Slices of
# segments are therefore worked in parallel: first each slice's map from every possible start state to its end state,
# then the maps are composed and chained per device, then each slice is run from its now known start. Ticks are only made at the
# end, by the same formula in SQL.

# Ticks per slice; a segment lasts at least one tick, so this bounds the rows of a slice.
SLICE_TICKS = 14_400


def _cycle(set_point: int, on_ticks: int) -> tuple[int, int]:
    """Length of the on and the off phase; at least a tick each, for the valve turns once per tick at most."""
    off_ticks = 2 * on_ticks if set_point == 1 else on_ticks
    return max(1, on_ticks), max(1, off_ticks)


def _run_segment(on, count, position, set_point: int, on_ticks: int, ticks: int):
    """End state of a segment for arrays of start states; ``turned`` tells where the counter was restarted."""
    if set_point < 0:
        return on, count + ticks, position, np.zeros(len(on), bool)
    if set_point not in (1, 2):
        direct = np.full(len(on), set_point != 0)
        return direct, count + ticks, np.full(len(on), set_point), np.zeros(len(on), bool)
    on_len, off_len = _cycle(set_point, on_ticks)
    threshold = np.where(on, on_ticks, 2 * on_ticks if set_point == 1 else on_ticks)
    first_turn = np.maximum(0, threshold - count)
    turned = first_turn < ticks
    since = (ticks - 1 - first_turn) % (on_len + off_len)
    phase = np.where(on, off_len, on_len)  # the phase the first turn leads to
    in_phase = since < phase
    new_on = np.where(in_phase, ~on, on)
    new_count = np.where(in_phase, since, since - phase) + 1
    return (
        np.where(turned, new_on, on),
        np.where(turned, new_count, count + ticks),
        np.where(turned, np.where(new_on, PULSE_POSITION, 0), position),
        turned,
    )


def _start_counts(segments: pd.DataFrame) -> np.ndarray:
    """The counter values at which a slice's outcome can change.

    A counter below ``threshold - ticks`` never reaches the threshold, one at or above it is there at once, and none
    exceeds the ticks since the start.
    """
    ticks, elapsed = int(segments["ticks"].sum()), int(segments["from_tick"].iloc[0])
    cycling = segments.loc[segments["set_point"].isin([1, 2]), "on_ticks"].to_numpy(dtype=np.int64)
    thresholds = np.unique(np.concatenate([cycling, 2 * cycling]))
    ranges = [np.arange(max(0, t - ticks), min(t, elapsed) + 1) for t in thresholds if t > 0]
    return np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *ranges]))


def _slice_map(segments: pd.DataFrame) -> pd.DataFrame:
    """What a slice makes of every start state: for each counter value from which the outcome differs, off and on."""
    segments = segments.sort_values("from_tick")
    starts = _start_counts(segments)
    on = np.repeat([False, True], len(starts))
    count = np.tile(starts, 2)
    position = np.full(len(on), -1, dtype=np.int64)  # -1: as at the start
    restarted = np.zeros(len(on), bool)
    for set_point, on_ticks, ticks in zip(segments["set_point"], segments["on_ticks"], segments["ticks"]):
        on, count, position, turned = _run_segment(on, count, position, int(set_point), int(on_ticks), int(ticks))
        restarted |= turned
    return pd.DataFrame(
        {
            "device": [segments["device"].iloc[0]],
            "slice": [segments["slice"].iloc[0]],
            "ticks": [int(segments["ticks"].sum())],
            "starts": [starts.tolist()],
            "on": [on.tolist()],
            "count_": [count.tolist()],
            "position": [position.tolist()],
            "restarted": [restarted.tolist()],
        }
    )


class _Map:
    """A slice's map, for looking up what becomes of a state."""

    def __init__(self, row):
        self.ticks, self.starts, self.restarted = int(row.ticks), np.asarray(row.starts), np.asarray(row.restarted)
        self.on, self.count, self.position = np.asarray(row.on), np.asarray(row.count_), np.asarray(row.position)

    def __call__(self, on, count, position):
        """End states of arrays of start states, and where the counter was restarted."""
        state = np.searchsorted(self.starts, count, side="right") - 1 + np.where(on, len(self.starts), 0)
        restarted = self.restarted[state]
        return (
            self.on[state],
            np.where(restarted, self.count[state], count + self.ticks),
            np.where(self.position[state] >= 0, self.position[state], position),
            restarted,
        )


def _compose(maps: pd.DataFrame, whole: str, part: str) -> pd.DataFrame:
    """The map of several slices in a row: a counter matters where it does to one of them, less the ticks before that one."""
    maps = maps.sort_values(part)
    own = [_Map(row) for row in maps.itertuples()]
    before = np.cumsum([0, *[m.ticks for m in own]])
    starts = np.unique(np.concatenate([np.zeros(1, np.int64), *[m.starts - b for m, b in zip(own, before)]]))
    starts = starts[starts >= 0]
    on, count = np.repeat([False, True], len(starts)), np.tile(starts, 2)
    position, restarted = np.full(len(on), -1, dtype=np.int64), np.zeros(len(on), bool)
    for m in own:
        on, count, position, turned = m(on, count, position)
        restarted |= turned
    # where two neighbouring counters come to the same, the larger need not be listed
    half = len(starts)
    differs = np.zeros(half, bool)
    for k in (slice(0, half), slice(half, 2 * half)):
        after = np.where(restarted[k], count[k], -1)
        equal = (np.diff(after) == 0) & (np.diff(on[k]) == 0) & (np.diff(position[k]) == 0) & (np.diff(restarted[k]) == 0)
        differs[1:] |= ~equal
    differs[0] = True
    chosen = np.tile(differs, 2)
    return pd.DataFrame(
        {
            "device": [maps["device"].iloc[0]],
            whole: [maps[whole].iloc[0]],
            "ticks": [int(before[-1])],
            "starts": [starts[differs].tolist()],
            "on": [on[chosen].tolist()],
            "count_": [count[chosen].tolist()],
            "position": [position[chosen].tolist()],
            "restarted": [restarted[chosen].tolist()],
        }
    )


def _chain(maps: pd.DataFrame, part: str) -> pd.DataFrame:
    """State each part starts from, given what the parts before it did; the first has ``begin`` or that of a new valve."""
    maps = maps.sort_values(part)
    first = maps.iloc[0]
    known = "begin_on" in maps
    on = np.array([bool(first["begin_on"]) if known else True])
    count = np.array([int(first["begin_count"]) if known else 0])
    position = np.array([int(first["begin_position"]) if known else DEFAULT_SET_POINT])
    starts = []
    for name, row in zip(maps[part], maps.itertuples()):
        starts.append((row.device, name, bool(on[0]), int(count[0]), int(position[0])))
        on, count, position, _ = _Map(row)(on, count, position)
    return pd.DataFrame(starts, columns=["device", part, "begin_on", "begin_count", "begin_position"])


def _replay(segments: pd.DataFrame) -> pd.DataFrame:
    """Start state of each segment of a slice."""
    segments = segments.sort_values("from_tick")
    first = segments.iloc[0]
    on = np.array([bool(first["on"])])
    count = np.array([int(first["count"])], dtype=np.int64)
    position = np.array([int(first["position"])], dtype=np.int64)
    states = []
    for set_point, on_ticks, ticks in zip(segments["set_point"], segments["on_ticks"], segments["ticks"]):
        states.append((bool(on[0]), int(count[0]), int(position[0])))
        on, count, position, _ = _run_segment(on, count, position, int(set_point), int(on_ticks), int(ticks))
    return segments.assign(
        on=[s[0] for s in states], count=[s[1] for s in states], position=[s[2] for s in states]
    )


def segments_of(commands: DataFrame, spans: DataFrame, **options) -> DataFrame:
    """Runs of ticks under one (set_point, on_ticks), from commands (device, ts, seq, set_pos, manual, on_ticks).

    ``spans`` gives ``first_ts`` and ``last_ts`` of each device; ticks are counted from the first.
    """
    state = carry_last(
        commands,
        ["device"],
        micros(F.col("ts")),
        F.col("seq"),
        {"_pos": F.col("set_pos"), "_man": F.col("manual"), "_n": F.col("on_ticks")},
        **options,
    )
    tick_us = TICK_S * 1_000_000
    first_us, last_us = micros(F.col("first_ts")), micros(F.col("last_ts"))
    tick = F.ceil((micros(F.col("ts")) - first_us) / F.lit(tick_us))
    after_end = (F.floor((last_us - first_us) / F.lit(tick_us)) + 1).alias("tick")
    at = order_key(micros(F.col("ts")), F.col("seq"))
    # a tick sees only the last command before it
    changes = (
        state.join(spans, "device")
        .where(micros(F.col("ts")) <= last_us)
        .groupBy("device", F.greatest(tick, F.lit(0)).alias("tick"))
        .agg(
            F.max_by(set_point_in_force(F.col("_man"), F.col("_pos")), at).alias("set_point"),
            F.max_by(F.coalesce("_n", F.lit(DEFAULT_ON_TICKS)), at).alias("on_ticks"),
            F.max_by(F.coalesce("_man", F.lit(AUTO_MODE)), at).alias("manual"),
        )
    )
    ends = spans.select("device", after_end)
    # several commands may take effect only after the last tick
    bounded = changes.join(ends.withColumnRenamed("tick", "_end"), "device").where(F.col("tick") < F.col("_end"))
    marks = cut_lineage(
        bounded.drop("_end").withColumn("_last", F.lit(0)).unionByName(
            ends.withColumn("_last", F.lit(1)), allowMissingColumns=True
        )
    )
    linked = carry_last(
        marks,
        ["device"],
        F.col("tick"),
        F.col("_last"),
        {
            "_from": F.col("tick"),
            "_set": F.col("set_point"),
            "_on": F.col("on_ticks"),
            "_mode": F.col("manual"),
        },
        strict=True,
        width=SLICE_TICKS,
    )
    start = F.coalesce("_from", F.lit(0))
    return linked.where(F.col("tick") > start).select(
        "device",
        start.alias("from_tick"),
        (F.col("tick") - start).alias("ticks"),
        F.coalesce("_set", F.lit(DEFAULT_SET_POINT)).cast("int").alias("set_point"),
        F.coalesce("_on", F.lit(DEFAULT_ON_TICKS)).cast("bigint").alias("on_ticks"),
        F.coalesce("_mode", F.lit(AUTO_MODE)).cast("int").alias("manual"),
    )


#: Slices in a part of the chain, and parts in one above it: ten days a slice, a year a part, 32 years the next.
PART_SLICES, PART_PARTS = 36, 32
_MAP = "ticks bigint, starts array<bigint>, on array<boolean>, count_ array<bigint>, position array<bigint>, restarted array<boolean>"
_BEGIN = "begin_on boolean, begin_count bigint, begin_position bigint"


def valve_timeline(commands: DataFrame, spans: DataFrame, slice_ticks: int = SLICE_TICKS, part_slices: int = PART_SLICES, **options) -> DataFrame:
    """Valve position at every tick (device, ts, set_point, position, dac, mode).

    The maps of slices are composed as a tree: slices to parts, parts to larger parts, and these are run through per device;
    then each larger part gives its parts, and each part its slices, the state they start from. A device with a long past
    is spread over as many tasks as it has parts.
    """
    spans = cut_lineage(spans)
    slice_ = F.floor(F.col("from_tick") / slice_ticks).cast("bigint")
    segments = cut_lineage(segments_of(commands, spans, **options).withColumn("slice", slice_))
    kind = segments.schema["device"].dataType.simpleString()
    maps = segments.groupBy("device", "slice").applyInPandas(_slice_map, f"device {kind}, slice bigint, {_MAP}")
    slices = cut_lineage(maps.withColumn("part", F.floor(F.col("slice") / part_slices)))
    parts = slices.groupBy("device", "part").applyInPandas(lambda m: _compose(m, "part", "slice"), f"device {kind}, part bigint, {_MAP}")
    parts = cut_lineage(parts.withColumn("top", F.floor(F.col("part") / PART_PARTS)))
    tops = parts.groupBy("device", "top").applyInPandas(lambda m: _compose(m, "top", "part"), f"device {kind}, top bigint, {_MAP}")
    of_tops = tops.groupBy("device").applyInPandas(lambda m: _chain(m, "top"), f"device {kind}, top bigint, {_BEGIN}")
    of_parts = parts.join(of_tops, ["device", "top"]).groupBy("device", "top").applyInPandas(lambda m: _chain(m, "part"), f"device {kind}, part bigint, {_BEGIN}")
    starts = slices.join(of_parts, ["device", "part"]).groupBy("device", "part").applyInPandas(lambda m: _chain(m, "slice"), f"device {kind}, slice bigint, {_BEGIN}")
    known = (
        segments.join(starts.withColumnsRenamed({"begin_on": "on", "begin_count": "count", "begin_position": "position"}), ["device", "slice"])
        .groupBy("device", "slice")
        .applyInPandas(
            _replay,
            f"device {kind}, slice bigint, from_tick bigint, ticks bigint, set_point int, on_ticks bigint, "
            "manual int, on boolean, count bigint, position bigint",
        )
    )
    return _expand(known, spans)


def _expand(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per tick, by day and then within it: the formula of ``_run_segment`` as columns."""
    on, cycling = F.col("on"), F.col("set_point").isin(1, 2)
    off_ticks = F.when(F.col("set_point") == 1, F.col("on_ticks") * 2).otherwise(F.col("on_ticks"))
    on_len, off_len = F.greatest("on_ticks", F.lit(1)), F.greatest(off_ticks, F.lit(1))
    first_turn = F.greatest(F.when(on, F.col("on_ticks")).otherwise(off_ticks) - F.col("count"), F.lit(0))
    day = 86_400 // TICK_S
    days = segments.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("ticks") - 1) / day))).alias("_day"))
    days = spread(days, "device", "from_tick", "_day")
    begin = F.col("_day") * day
    ticks = days.select("*", F.explode(F.sequence(begin, F.least(begin + day, F.col("ticks")) - 1)).alias("_j"))
    phase = F.when(on, off_len).otherwise(on_len)
    since = F.pmod(F.col("_j") - first_turn, on_len + off_len)
    valve_on = F.when(since < phase, ~on).otherwise(on)
    cycled = F.when(F.col("_j") < first_turn, F.col("position")).otherwise(
        F.when(valve_on, F.lit(PULSE_POSITION)).otherwise(F.lit(0))
    )
    position = (
        F.when(cycling, cycled).when(F.col("set_point") < 0, F.col("position")).otherwise(F.col("set_point"))
    ).cast("int")
    seconds = (F.col("from_tick") + F.col("_j")) * TICK_S
    at = F.col("first_ts") + F.make_dt_interval(secs=seconds)
    return (
        ticks.withColumn("position", position)
        .join(spans.select("device", "first_ts"), "device")
        .select(
            "device",
            at.alias("ts"),
            "set_point",
            "position",
            dac_value(F.col("position")).alias("dac"),
            mode_label(F.col("manual")).alias("mode"),
        )
    )


def report_state(timeline: DataFrame, measurements: DataFrame, log: DataFrame, **options) -> DataFrame:
    """The timeline with what a valve knows at each tick: its last measurements, and the text of a standing error.

    ``measurements`` has (device, ts, seq) and temp_in, temp_out and light, each NULL where not measured; ``log`` has (device,
    ts, seq, kind, code) as in ``error_latch``, whose own ticks do not count: those of the timeline do. All three logs are one
    stream of rows that is carried along together; what was received at the instant of a tick counts.
    """
    values = ["temp_in", "temp_out", "light"]
    shown = [c for c in timeline.columns if c not in ("device", "ts")]
    rows = (
        timeline.withColumns({"seq": F.lit(_AFTER), "kind": F.lit("tick")})
        .unionByName(measurements.select("device", "ts", "seq", *values), allowMissingColumns=True)
        .unionByName(log.where("kind <> 'tick'").select("device", "ts", "seq", "kind", "code"), allowMissingColumns=True)
    )
    state = error_latch(rows, carried=values, **options).where("kind = 'tick'")
    text = F.when(F.col("active"), F.coalesce(_error_text(F.col("published_code")), F.lit("")))
    return state.select("device", "ts", *shown, *values, text.alias("error_text"))


def _error_text(code: Column) -> Column:
    texts = F.create_map(*[x for c, text in ERROR_TEXTS.items() for x in (F.lit(c), F.lit(text))])
    return F.try_element_at(texts, code)


def valve_report(timeline: DataFrame) -> DataFrame:
    """The messages a valve publishes each tick, with its own measurements where the timeline carries them."""
    payloads = {
        "ActPos": ("dac", lambda c: fixed_decimals(c, 1, 0)),
        "Mode": ("set_point", lambda c: fixed_decimals(c, 1, 0)),
        "TempIn": ("temp_in", lambda c: fixed_decimals(c, 3, 2)),
        "TempOut": ("temp_out", lambda c: fixed_decimals(c, 3, 2)),
        "Light": ("light", lambda c: fixed_decimals(c, 1, 0)),
        "ManAuto": ("mode", lambda c: c),
        "Err": ("error_text", lambda c: c),
    }
    sent = [
        F.when(F.col(column).isNotNull(), F.struct(F.lit(name).alias("name"), text(F.col(column)).alias("payload")))
        for name, (column, text) in payloads.items()
        if column in timeline.columns
    ]
    messages = timeline.select("device", "ts", F.explode(F.array_compact(F.array(*sent))).alias("_m"))
    return messages.select(
        "device", "ts", F.concat(F.lit("ValveControl/"), "_m.name").alias("topic"), F.col("_m.payload").alias("payload")
    )


def error_messages(latch: DataFrame) -> DataFrame:
    """What each tick publishes about errors: the text of the delayed code, empty at a device's first report."""
    reports = latch.where((F.col("kind") == "tick") & F.col("active"))
    return reports.select(
        "device",
        "ts",
        F.lit("ValveControl/Err").alias("topic"),
        F.coalesce(_error_text(F.col("published_code")), F.lit("")).alias("payload"),
    )


def error_latch(log: DataFrame, carried: Sequence[str] = (), **options) -> DataFrame:
    """Error state after each row of a device log (device, ts, seq, kind, code), and the code each tick publishes.

    ``kind`` is error, ack, reconnect, dac_ok or tick. An error stays until acknowledged; code 4 is also cleared by a
    reconnect and code 6 by a working converter. A tick publishes the code that stood at the last tick with an error
    before it, none at the first. Columns named in ``carried`` keep their last value.
    """
    at = order_key(micros(F.col("ts")), F.col("seq"))

    def when_kind(kind: str) -> Column:
        return F.when(F.col("kind") == kind, at)

    known = carry_last(
        log,
        ["device"],
        micros(F.col("ts")),
        F.col("seq"),
        {
            "_error": when_kind("error"),
            "_code": F.when(F.col("kind") == "error", F.col("code")),
            "_ack": when_kind("ack"),
            "_reconnect": when_kind("reconnect"),
            "_dac": when_kind("dac_ok"),
            **{f"_kept_{c}": F.col(c) for c in carried},
        },
        **options,
    ).withColumns({c: F.col(f"_kept_{c}") for c in carried})

    def cleared(clear: str, only_code: int | None = None) -> Column:
        later = F.coalesce(F.col(clear) > F.col("_error"), F.lit(False))
        return later if only_code is None else later & (F.col("_code") == only_code)

    active = F.col("_error").isNotNull() & ~(
        cleared("_ack") | cleared("_reconnect", ERR_CLEARED_BY_RECONNECT) | cleared("_dac", ERR_CLEARED_BY_DAC)
    )
    state = cut_lineage(
        known.select(*log.columns, active.alias("active"), F.when(active, F.col("_code")).alias("error_code"))
    )
    reporting = F.when((F.col("kind") == "tick") & F.col("active"), F.col("error_code"))
    delayed = carry_last(
        state, ["device"], micros(F.col("ts")), F.col("seq"), {"_before": reporting}, strict=True, **options
    )
    return delayed.withColumn("published_code", F.when(reporting.isNotNull(), F.col("_before"))).drop("_before")
