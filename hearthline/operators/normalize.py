"""Validation and calibration of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.constants import (
    CAPABILITY_BITS,
    COLOUR_FIELDS,
    FIELD_CAPABILITY,
    LIMITS,
    NOT_RECEIVED,
    RADIO_UNSET,
    SCALED_FIELDS,
    V0_OTHER_UNSET,
    V0_TEMP_UNSET,
    VALUE_FIELDS,
)
from hearthline.functions.scalar import fixed_point, has_capability


def plausible_value(field: str, value: Column) -> Column:
    """The value if it lies within the field's limits, else NULL."""
    lo, inclusive, hi = LIMITS[field]
    above = value >= lo if inclusive else value > lo
    return F.when(above & (value < hi), value)


def plausible(readings: DataFrame) -> DataFrame:
    return readings.withColumns({f: plausible_value(f, F.col(f)) for f in LIMITS if f in readings.columns})


def without_sentinels(value: Column, *sentinels: int) -> Column:
    """NULL for "not received", the radio default, NaN and the given further sentinels."""
    unset = value.isin(NOT_RECEIVED, RADIO_UNSET, *sentinels) | F.isnan(value.cast("double"))
    return F.when(~unset, value)


def null_sentinels(readings: DataFrame) -> DataFrame:
    """Sentinels to NULL in raw radio columns and in wide reading columns, whichever are present."""
    by_column = {
        "temp_a": (V0_TEMP_UNSET,),
        "temp_b": (V0_TEMP_UNSET,),
        "humi": (V0_OTHER_UNSET,),
        "volt": (V0_OTHER_UNSET,),
        **{f: () for f in COLOUR_FIELDS},
    }
    cleaned = {c: without_sentinels(F.col(c), *s) for c, s in by_column.items() if c in readings.columns}
    # scaled integers may well be -99; for them only "not received" is a sentinel
    cleaned |= {c: F.when(F.col(c) != NOT_RECEIVED, F.col(c)) for c in SCALED_FIELDS if c in readings.columns}
    return readings.withColumns(cleaned)


def row_sum(readings: DataFrame, caps: str) -> Column:
    """Checksum of a reading: the capability mask plus all values present; NULL if no 32-bit number can hold it."""
    total = F.col(caps).cast("int")
    for field in VALUE_FIELDS:
        if field in readings.columns:
            total = F.try_add(total, F.coalesce(F.col(field), F.lit(0)))
    return total


def with_checksum(frames: DataFrame) -> DataFrame:
    """Add ``checksum`` and ``checksum_ok``; an absent received sum is a failure."""
    summed = frames.withColumn("checksum", row_sum(frames, "SensCap"))
    return summed.withColumn("checksum_ok", F.coalesce(F.col("iCSum") == F.col("checksum"), F.lit(False)))


def with_channel_check(readings: DataFrame, lo: int, hi: int, channel: str = "channel") -> DataFrame:
    """Mark the rows of known channels; the others are kept apart, not lost."""
    return readings.withColumn("accepted", F.coalesce(F.col(channel).between(lo, hi), F.lit(False)))


def capability_flags(readings: DataFrame, caps: str = "caps") -> DataFrame:
    return readings.withColumns({f"has_{n}": has_capability(F.col(caps), n) for n in CAPABILITY_BITS})


def gate(readings: DataFrame, caps: Column) -> DataFrame:
    """NULL out the columns whose capability bit is not set in ``caps``."""
    return readings.withColumns(
        {f: F.when(has_capability(caps, c), F.col(f)) for f, c in FIELD_CAPABILITY.items() if f in readings.columns}
    )


def with_sensor(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Look up the sensor registry by channel.

    No hint: the registry written as VALUES is far below the broadcast threshold, a larger one is joined as Spark's
    size estimate tells.
    """
    return readings.join(sensors, "channel", "left")


def calibrate(packets: DataFrame, sensors: DataFrame) -> DataFrame:
    """Raw radio floats plus the channel's corrections, as fixed-point integers."""
    corrected = with_sensor(packets, sensors.select("channel", "batt_corr", "temp_a_corr", "temp_b_corr"))

    def scaled(value: str, corr: str) -> Column:
        return fixed_point(F.col(value) + F.coalesce(F.col(corr), F.lit(0.0)))

    return corrected.withColumns(
        {
            "iTempA": scaled("temp_a", "temp_a_corr"),
            "iTempB": scaled("temp_b", "temp_b_corr"),
            "iVolt": scaled("volt", "batt_corr"),
            "iHumi": fixed_point(F.col("humi")),
        }
    ).drop("batt_corr", "temp_a_corr", "temp_b_corr")


def effective_capabilities(packets: DataFrame, sensors: DataFrame) -> DataFrame:
    """A packet that carries capabilities wins over the static registry."""
    known = with_sensor(packets, sensors.select("channel", "static_caps"))
    return known.withColumn("effective_caps", F.coalesce("caps", "static_caps", F.lit(0))).drop("static_caps")
