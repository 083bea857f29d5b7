"""Packets, frames and messages to readings and points, and back. Stateless, the same in batch and in a stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.constants import (
    COLOUR_FIELDS,
    FIELD_CAPABILITY,
    FRAME_FIELDS,
    NOT_RECEIVED,
    SCALED_FIELDS,
    TOPIC_FIELD,
    VALUE_FIELDS,
)
from hearthline.functions.scalar import (
    fixed_decimals,
    from_fixed_point,
    has_capability,
    lenient_int,
    topic,
    with_unit,
)
from hearthline.operators.normalize import null_sentinels, plausible, row_sum, with_channel_check, with_checksum
from hearthline.operators.ordered import carry_last, order_key

FRAME_SCHEMA = ", ".join(f"{name} INT" for name in FRAME_FIELDS)

# Legacy frames: the keys of each sensor by reading (fixed values).
LEGACY_KEYS = {
    0: {"iLight": "iLightLoc", "fAtmo": "fAtmoLoc"},
    1: {"fTempA": "fTemp1A", "fHumi": "fHumi1", "fVolt": "fVolt1"},
    2: {"fTempA": "fTemp2A", "fVolt": "fVolt2"},
    3: {"fTempA": "fTemp3A", "fVolt": "fVolt3"},
    4: {"fTempA": "fTemp4A", "fHumi": "fHumi4", "fVolt": "fVolt4"},
    5: {"fTempA": "fTemp5A", "fHumi": "fHumi5", "fVolt": "fVolt5"},
}
LEGACY_FIELDS = ["fTempA", "fHumi", "fVolt", "iLight", "fAtmo"]


def split_frames(log: DataFrame, text: str = "text") -> DataFrame:
    """Payloads between the start and end markers, one row each, with their place in the text.

    Bytes before a start marker are skipped, and a frame without an end is dropped. Frames may be of any length.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(r"%([^$]*)\$"), F.lit(1))
    others = [c for c in log.columns if c != text]
    frames = log.select(*others, F.posexplode(found).alias("frame_no", "payload"))
    return frames


def split_frames_across_rows(
    log: DataFrame, keys: Sequence[str], position: Column, text: str = "text", **options
) -> DataFrame:
    """Payloads of frames that may begin in one row of a port's log and end in a later one, with the row they end in.

    Rows of a port (``keys``) are ordered by ``position`` and ``seq``. What follows the first end marker of a row is cut in one
    narrow pass. Only the edges of rows, up to the first end marker and after the last one, are shuffled: whether a frame is open
    when a row begins follows from the last marker before the row, for after a start marker a frame is open and after an end
    marker none is. The parts of a frame share the last row with an end marker before them; what follows a port's last end
    marker is never put together.
    """
    keys = list(keys)
    whole, ends = F.col(text), F.col(text).contains("$")
    frames = lambda column: F.regexp_extract_all(column, F.lit(r"%([^$]*)\$"), F.lit(1))
    # cuts at markers are searches of a byte: a pattern that looks for the last marker would start anew at every character
    beyond = lambda column, mark: F.substr(column, F.instr(column, mark) + 1)
    opened_in = lambda column: F.when(column.contains("%"), beyond(column, "%")).otherwise("")
    log = log.withColumns({"_ends": ends, "_tail": F.when(ends, F.substring_index(whole, "$", -1))})
    inside = log.where("_ends").select(*keys, "seq", F.explode(frames(beyond(whole, "$"))).alias("payload"))
    last = F.when(F.coalesce("_tail", whole).contains("%"), "%").when(F.col("_ends"), "$")
    edges = log.select(
        *keys,
        "seq",
        position.alias("_at"),
        "_ends",
        F.substring_index(whole, "$", 1).alias("_head"),
        F.when(F.col("_ends"), opened_in(F.col("_tail"))).alias("_tail"),
        last.alias("_last"),
    )
    at = order_key(F.col("_at"), F.col("seq"))
    # the row with a port's last end marker
    closed = edges.where("_ends").groupBy(*keys).agg(F.max_by("seq", at).alias("_closed"))
    known = carry_last(
        edges,
        keys,
        F.col("_at"),
        F.col("seq"),
        {"_marker": F.col("_last"), "_ended": F.when(F.col("_ends"), F.col("seq"))},
        strict=True,
        **options,
    )
    is_open = F.coalesce(F.col("_marker") == "%", F.lit(False))
    part = "STRUCT<group: BIGINT, part: STRING, ends_at: BIGINT>"
    # a frame that lies before the first end marker of its row is one part
    head = F.when(F.col("_ends") & F.col("_head").contains("%"), opened_in(F.col("_head")))
    beginning = F.when(is_open, F.col("_head")).otherwise(head)
    tail = F.when(F.col("_ends"), F.col("_tail")).when(~is_open, opened_in(F.col("_head")))
    first = F.struct(F.col("_ended"), beginning, F.when(F.col("_ends"), F.col("seq"))).cast(part)
    second = F.struct(F.when(F.col("_ends"), F.col("seq")).otherwise(F.col("_ended")), tail, F.lit(None)).cast(part)
    parts = known.select(
        *keys, "_at", "seq", F.inline(F.array_compact(F.array(F.when(beginning.isNotNull(), first), F.when(tail != "", second))))
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    of_port = closed.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    complete = parts.join(of_port, reduce(and_, same)).where(~F.col("group").eqNullSafe(F.col("_closed")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_at", "seq", "part"))), lambda p: p["part"])
    spanning = complete.groupBy(*keys, "group").agg(F.max("ends_at").alias("seq"), F.concat_ws("", in_order).alias("payload"))
    return inside.unionByName(spanning.where("seq IS NOT NULL").select(*keys, "seq", "payload"))


def parse_frames(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Uniform JSON frames to columns.

    Absent keys, and values that are no integers, are NULL; ``bad_json`` marks what does not parse or has no known key.
    """
    others = [c for c in frames.columns if c != payload]
    rows = frames.select(*others, _parsed(F.col(payload), FRAME_SCHEMA))
    return rows.select(*others, F.coalesce(*FRAME_FIELDS).isNull().alias("bad_json"), *FRAME_FIELDS)


def _parsed(text: Column, schema: str) -> Column:
    """The keys of a JSON text as columns.

    As a generator it is evaluated once; a plain column would be repeated in every later filter that names a key.
    """
    return F.inline(F.array(F.from_json(text, schema)))


def parse_frames_legacy(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Frames with one set of key names per sensor, to the same columns for all sensors.

    A frame counts if the truncated sum of its sensor's readings, absent ones as 999999, stays below 999999.
    Readings absent from an accepted frame are NULL.
    """
    keys = [key for by_field in LEGACY_KEYS.values() for key in by_field.values()]
    schema = "sensor INT, time INT, " + ", ".join(f"{key} DOUBLE" for key in keys)
    others = [c for c in frames.columns if c != payload]
    rows = frames.select(*others, _parsed(F.col(payload), schema))

    def of_sensor(values: dict[int, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("sensor") == n, v) for n, v in values.items()])

    columns = {
        field: of_sensor({n: F.col(k[field]) for n, k in LEGACY_KEYS.items() if field in k})
        for field in LEGACY_FIELDS
    }
    totals = {}
    for n, by_field in LEGACY_KEYS.items():
        present = [F.coalesce(F.col(key), F.lit(float(NOT_RECEIVED))) for key in by_field.values()]
        totals[n] = sum(present[1:], present[0]).try_cast("int")
    accepted = F.coalesce(of_sensor(totals) < NOT_RECEIVED, F.lit(False))
    return rows.select(
        *others,
        "sensor",
        "time",
        accepted.alias("accepted"),
        *[F.when(accepted & (c < NOT_RECEIVED), c).alias(name) for name, c in columns.items()],
    )


def to_frames(readings: DataFrame, counter: Column) -> DataFrame:
    """Readings as marked JSON frames with plausible values only and their checksum, in wire order."""
    valid = plausible(readings)
    fields = [f for f in VALUE_FIELDS if f in valid.columns]
    body = F.struct(
        F.col("channel").alias("sensor"),
        counter.alias("time"),
        F.col("caps").alias("SensCap"),
        *fields,
        row_sum(valid, "caps").alias("iCSum"),
    )
    return valid.select("seq", "channel", F.concat(F.lit("%"), F.to_json(body), F.lit("$")).alias("text"))


def to_frames_legacy(readings: DataFrame, counter: Column) -> DataFrame:
    """Readings as frames of the older schema: floats under one set of key names per sensor, no checksum.

    The writer misspells the humidity of sensor 4, so that the reader never finds it. Unknown sensors send nothing.
    """
    texts = []
    for sensor, by_field in LEGACY_KEYS.items():
        values = [F.col(f).alias("fHumi4]" if key == "fHumi4" else key) for f, key in by_field.items()]
        body = F.struct(F.lit(sensor).alias("sensor"), counter.alias("time"), *values)
        texts.append(F.when(F.col("channel") == sensor, F.to_json(body)))
    framed = readings.withColumn("_json", F.coalesce(*texts)).where(F.col("_json").isNotNull())
    return framed.select("seq", "channel", F.concat(F.lit("%"), "_json", F.lit("$")).alias("text"))


def finite(value: Column) -> Column:
    """The number, NULL for NaN and infinities: one of them would spoil every mean above it."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def to_messages_legacy(readings: DataFrame) -> DataFrame:
    """Readings of the older schema as (topic, payload); channel 0 reports as ``SensorLoc``."""
    device = F.when(F.col("channel") == 0, F.lit("SensorLoc")).otherwise(
        F.concat(F.lit("Sensor"), F.col("channel").cast("string"))
    )
    pairs = []
    for field in LEGACY_FIELDS:
        payload = fixed_decimals(F.col(field), 3, 0) if field == "iLight" else fixed_decimals(F.col(field), 4, 2)
        senders = [sensor for sensor, by_field in LEGACY_KEYS.items() if field in by_field]
        sent = F.col("channel").isin(senders) & finite(F.col(field)).isNotNull()
        pair = F.struct(F.concat(device, F.lit(f"/{field}")).alias("topic"), payload.alias("payload"))
        pairs.append(F.when(sent, pair))
    messages = readings.select("seq", "ts", F.explode(F.array_compact(F.array(*pairs))).alias("_m"))
    return messages.select("seq", "ts", "_m.topic", "_m.payload")


def to_messages(readings: DataFrame) -> DataFrame:
    """Wide readings as (topic, payload), one row per supported and present field."""
    pairs = []
    for field, name in TOPIC_FIELD.items():
        if field not in readings.columns:
            continue
        if field in COLOUR_FIELDS:
            payload = fixed_decimals(F.col(field), 4, 0)
        else:
            payload = fixed_decimals(from_fixed_point(F.col(field)), 4, 3)
        sent = has_capability(F.col("caps"), FIELD_CAPABILITY[field]) & F.col(field).isNotNull()
        pairs.append(F.when(sent, F.struct(topic(F.col("channel"), F.lit(name)).alias("topic"), payload.alias("payload"))))
    messages = readings.select("seq", "ts", F.explode(F.array_compact(F.array(*pairs))).alias("_m"))
    return messages.select("seq", "ts", "_m.topic", "_m.payload")


def route_messages(messages: DataFrame, device: str = "ValveControl") -> DataFrame:
    """Typed columns by exact topic; a topic nobody listens to leaves them all NULL."""

    def on(name: str, value: Column) -> Column:
        return F.when(F.col("topic") == name, value)

    payload = F.col("payload")
    return messages.withColumns(
        {
            "set_pos": on(f"{device}/SetPos", lenient_int(payload)),
            "set_int": on(f"{device}/SetInt", lenient_int(payload)),
            "thermo_text": on("Thermo", with_unit(payload, "°C")),
            "humi_text": on("Humi", with_unit(payload, "%")),
        }
    )


def messages_to_points(messages: DataFrame, tier: str = "autogen") -> DataFrame:
    """Sensor messages as points: ``Sensor3/fTempA`` is field ``fTempA`` of ``sSens3``, channel 0 is ``SensorLoc``."""
    device = F.split_part(F.col("topic"), F.lit("/"), F.lit(1))
    # a payload that is no finite number makes no point, see message_rejects
    measurement = F.when(device.isin("Sensor0", "SensorLoc"), F.lit("SensorLoc")).otherwise(
        F.regexp_replace(device, r"^Sensor(\d+)$", "sSens$1")
    )
    return messages.select(
        F.lit(tier).alias("tier"),
        measurement.alias("measurement"),
        F.col("ts").alias("time"),
        F.split_part(F.col("topic"), F.lit("/"), F.lit(2)).alias("field"),
        finite(F.col("payload").try_cast("double")).alias("value"),
        F.col("seq").alias("write_seq"),
    ).where(F.col("value").isNotNull())


def message_rejects(messages: DataFrame) -> DataFrame:
    """Messages that ``messages_to_points`` leaves out: their payload is no finite number."""
    lost = messages.where(finite(F.col("payload").try_cast("double")).isNull())
    return lost.withColumn("reason", F.lit("number"))


#: First and last channel of the sensors.
CHANNELS = (0, 9)


def _judged(log: DataFrame, channels: tuple[int, int]) -> DataFrame:
    """Parsed frames with their text in ``frame`` and what speaks against them."""
    split = split_frames(log).withColumn("frame", F.col("payload"))
    return with_channel_check(with_checksum(parse_frames(split)), *channels, "sensor")


def readings_to_points(readings: DataFrame, tier: str = "autogen") -> DataFrame:
    """Wide readings (seq, ts, channel, caps, values) as points, one for each supported and present field."""
    pairs = []
    for field, name in TOPIC_FIELD.items():
        if field in readings.columns:
            number = F.col(field).cast("double")
            value = number / F.lit(100.0) if field in SCALED_FIELDS else number
            sent = has_capability(F.col("caps"), FIELD_CAPABILITY[field]) & F.col(field).isNotNull()
            pairs.append(F.when(sent, F.struct(F.lit(name).alias("field"), value.alias("value"))))
    points = readings.select("seq", "ts", "channel", F.inline(F.array_compact(F.array(*pairs))))
    named = F.concat(F.lit("sSens"), F.col("channel").cast("string"))
    return points.select(
        F.lit(tier).alias("tier"),
        F.when(F.col("channel") == 0, F.lit("SensorLoc")).otherwise(named).alias("measurement"),
        F.col("ts").alias("time"),
        "field",
        "value",
        F.col("seq").alias("write_seq"),
    )


def frames_to_points(log: DataFrame, tier: str = "autogen", channels: tuple[int, int] = CHANNELS) -> DataFrame:
    """The whole ingest path: text log to stored points. Needs ``ts`` and ``seq`` columns beside ``text``.

    Frames that do not parse, have a wrong sum or an unknown channel make no points; ``ingest_rejects`` lists them.
    """
    frames = _judged(log, channels)
    good = frames.where(F.col("checksum_ok") & F.col("accepted"))
    readings = good.select(
        "seq", "ts", F.col("sensor").alias("channel"), F.col("SensCap").alias("caps"), *SCALED_FIELDS, *COLOUR_FIELDS
    )
    return readings_to_points(plausible(null_sentinels(readings)), tier)


def ingest_rejects(log: DataFrame, channels: tuple[int, int] = CHANNELS) -> DataFrame:
    """Frames that ``frames_to_points`` leaves out, with the first reason: json, checksum or channel."""
    reason = (
        F.when(F.col("bad_json"), F.lit("json"))
        .when(~F.col("checksum_ok"), F.lit("checksum"))
        .when(~F.col("accepted"), F.lit("channel"))
    )
    frames = _judged(log, channels).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return frames.select("seq", "ts", "frame_no", F.col("frame").alias("payload"), "reason")
