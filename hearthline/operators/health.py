"""Silence, staleness and last known values of sensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.constants import COLOUR_FIELDS, FIELD_CAPABILITY, VALUE_FIELDS
from hearthline.functions.scalar import has_capability, topic
from hearthline.operators.normalize import with_sensor
from hearthline.operators.ordered import HOUR_US, carry_last, micros, order_key
from hearthline.session import spread


def with_previous_time(
    readings: DataFrame, keys: Sequence[str], time: str = "ts", seq: str = "seq", width: int = HOUR_US
) -> DataFrame:
    """Add ``previous``: the time of the reading before, NULL for a sensor's first."""
    return carry_last(
        readings,
        keys,
        micros(F.col(time)),
        F.col(seq),
        {"previous": F.col(time)},
        strict=True,
        rising=True,
        width=width,
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def since_last(readings: DataFrame, keys: Sequence[str] = ("channel",), time: str = "ts", **options) -> DataFrame:
    """Add ``since_s``: seconds since the sensor's reading before."""
    linked = with_previous_time(readings, keys, time, **options)
    return linked.withColumn("since_s", seconds_between(F.col("previous"), F.col(time))).drop("previous")


def silence_gaps(
    readings: DataFrame,
    limit_s: int,
    keys: Sequence[str] = ("channel",),
    time: str = "ts",
    as_of: Column | None = None,
    **options,
) -> DataFrame:
    """Each silence longer than the limit: the readings on both sides of it.

    With ``as_of`` also the silences that have not ended by then; they have no ``silent_to``.
    """
    linked = with_previous_time(readings, keys, time, **options)
    gap = seconds_between(F.col("previous"), F.col(time))
    ended = linked.where(gap > limit_s).select(
        *keys, F.col("previous").alias("silent_from"), F.col(time).alias("silent_to"), gap.alias("gap_s")
    )
    if as_of is None:
        return ended
    newest = readings.groupBy(*keys).agg(F.max(time).alias("silent_from"))
    so_far = seconds_between(F.col("silent_from"), as_of)
    never = F.lit(None).cast(readings.schema[time].dataType)
    return ended.unionByName(
        newest.where(so_far > limit_s).select(*keys, "silent_from", never.alias("silent_to"), so_far.alias("gap_s"))
    )


def silence_alarms(
    gaps: DataFrame, limit_s: int, every_s: int, key: str = "channel", as_of: Column | None = None
) -> DataFrame:
    """The alarm messages of each silence: the first when the limit has passed, repeated until the next reading.

    A silence that has not ended is repeated up to ``as_of``.
    """
    first = F.col("silent_from") + F.make_dt_interval(secs=F.lit(limit_s))
    until = F.col("silent_to") if as_of is None else F.coalesce("silent_to", as_of)
    day = max(1, 86_400 // every_s)
    count = F.floor((micros(until) - micros(first)) / F.lit(every_s * 1_000_000)) + 1
    # by day first, so that no row becomes a long array
    due = gaps.select(key, "silent_from", count.alias("_n")).where("_n > 0")
    days = due.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / day))).alias("_day"))
    begin = F.col("_day") * day
    alarms = spread(days, key, "silent_from", "_day").select(
        "*", F.explode(F.sequence(begin, F.least(begin + day, F.col("_n")) - 1)).alias("_k")
    )
    return alarms.select(
        (first + F.make_dt_interval(secs=F.col("_k") * every_s)).alias("ts"),
        topic(F.col(key), F.lit("Err")).alias("topic"),
        F.lit("1").alias("payload"),
    )


def stale_sensors(
    readings: DataFrame, sensors: DataFrame, as_of: Column, limits_s: dict[str, int], used_only: Sequence[str] = ()
) -> DataFrame:
    """Sensors of the registry whose last reading is older than a board's limit, or that were never seen.

    Boards in ``used_only`` leave out channels without any capability.
    """
    last_seen = readings.groupBy("channel").agg(F.max("ts").alias("last_seen"))
    known = sensors.join(last_seen, "channel", "left")
    age = seconds_between(F.col("last_seen"), as_of)
    boards = F.array(*[F.struct(F.lit(b).alias("board"), F.lit(s).alias("limit_s")) for b, s in limits_s.items()])
    judged = known.select("channel", "static_caps", "last_seen", age.alias("age_s"), F.inline(boards))
    judged = judged.where(~F.col("board").isin(list(used_only)) | (F.col("static_caps") != 0))
    stale = judged.where(F.col("last_seen").isNull() | (F.col("age_s") > F.col("limit_s")))
    return stale.select("board", "channel", "last_seen", "age_s")


def first_seen(packets: DataFrame, identity: str = "mac", keys: Sequence[str] = ("channel",)) -> DataFrame:
    """The first packet of each channel registers its address."""
    at = order_key(micros(F.col("ts")), F.col("seq"))
    return packets.groupBy(*keys).agg(F.min_by(identity, at).alias(identity), F.min("ts").alias("first_ts"))


def carry_forward(
    readings: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("channel",), **options
) -> DataFrame:
    """Sensor state after each packet: a field the packet lacks keeps its last value."""
    state = carry_last(
        readings, keys, micros(F.col("ts")), F.col("seq"), {f"_state_{f}": F.col(f) for f in fields}, **options
    )
    return state.withColumns({f: F.col(f"_state_{f}") for f in fields}).drop(*[f"_state_{f}" for f in fields])


def gate_by_previous(packets: DataFrame, sensors: DataFrame, **options) -> DataFrame:
    """Temperature, humidity and voltage gated by the capabilities known before the packet, as the radio hub does.

    Only packets that carry capabilities change what is known; before the first of them the static registry holds.
    Colours are gated by the packet's own capabilities.
    """
    known = carry_last(
        packets, ["channel"], micros(F.col("ts")), F.col("seq"), {"_earlier": F.col("caps")}, strict=True, **options
    )
    known = with_sensor(known, sensors.select("channel", "static_caps"))
    gated = known.withColumn("gate_caps", F.coalesce("_earlier", "static_caps", F.lit(0)))
    columns = {}
    for field, capability in FIELD_CAPABILITY.items():
        if field in packets.columns:
            caps = F.col("caps") if field in COLOUR_FIELDS else F.col("gate_caps")
            columns[field] = F.when(has_capability(caps, capability), F.col(field))
    return gated.withColumns(columns).drop("_earlier", "static_caps")


def latest_board(points: DataFrame, by: Sequence[str] = ("measurement", "field")) -> DataFrame:
    """The newest value of every field, with its time."""
    at = order_key(micros(F.col("time")), F.col("write_seq"))
    return points.groupBy(*by).agg(F.max_by("value", at).alias("value"), F.max("time").alias("time"))


def latest_state(readings: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """One row per sensor: each field's last known value and the time of the last packet."""
    at = order_key(micros(F.col("ts")), F.col("seq"))
    fields = [f for f in VALUE_FIELDS if f in readings.columns]
    return readings.groupBy(*keys).agg(
        F.max("ts").alias("last_seen"), *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    )


def sample_last(readings: DataFrame, width_s: int = 15, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """What is sent each period: the last reading of every sensor heard in it. For batch and stream."""
    at = order_key(micros(F.col("ts")), F.col("seq"))
    carried = [c for c in readings.columns if c not in (*keys, "ts")]
    sampled = readings.groupBy(*keys, F.window("ts", f"{width_s} seconds").alias("_period")).agg(
        F.max("ts").alias("ts"), *[F.max_by(c, at).alias(c) for c in carried]
    )
    return sampled.select(*keys, F.col("_period.end").alias("sent_at"), "ts", *carried)


def wide_snapshot(readings: DataFrame, slots: dict[str, tuple[int, str]]) -> DataFrame:
    """Latest valid readings of several sensors as one row: ``{slot: (channel, field)}``."""
    at = order_key(micros(F.col("ts")), F.col("seq"))
    columns = []
    for slot, (channel, field) in slots.items():
        valid = (F.col("channel") == channel) & F.col(field).isNotNull()
        columns.append(F.max_by(F.col(field), F.when(valid, at)).alias(slot))
    return readings.agg(*columns)
