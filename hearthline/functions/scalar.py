"""Column functions: units, bits, lenient numbers, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.constants import (
    ADC_VOLT,
    AUTO_MODE,
    CAPABILITY_BITS,
    DAC_MAX,
    LEGACY_LUX_DIVISOR,
    LORA_SOURCES,
    MAX_POSITION,
    PLACEHOLDER,
    SEA_LEVEL_PA,
)


def has_capability(caps: Column, name: str) -> Column:
    return caps.bitwiseAND(F.lit(CAPABILITY_BITS[name])) != 0


def fixed_point(value: Column) -> Column:
    """Two decimals as an integer, halves rounded away from zero; NULL if that is no 32-bit number."""
    return F.round(value * F.lit(100.0)).try_cast("int")


def from_fixed_point(value: Column) -> Column:
    return value / F.lit(100.0)


def adc_to_volt(count: Column) -> Column:
    return count * F.lit(ADC_VOLT)


def sea_level_pressure(pascal: Column) -> Column:
    return pascal + F.lit(SEA_LEVEL_PA)


def hectopascal(pascal: Column) -> Column:
    return pascal / F.lit(100.0)


def light_count(high: Column, low: Column) -> Column:
    """Two bytes, high byte first."""
    return F.shiftleft(high.cast("int"), 8) + low.cast("int")


def light_scaled(count: Column) -> Column:
    return F.try_multiply(count, F.lit(100)).cast("int")


def light_legacy(count: Column) -> Column:
    return (count / F.lit(LEGACY_LUX_DIVISOR)).try_cast("int")


def load_voltage(bus_volt: Column, shunt_millivolt: Column) -> Column:
    return bus_volt + shunt_millivolt / F.lit(1000.0)


def dac_value(position: Column) -> Column:
    """Valve position 0..5 on the converter's scale, integer division."""
    scaled = position.cast("bigint") * F.lit(DAC_MAX)
    return ((scaled - scaled % F.lit(MAX_POSITION)) / F.lit(MAX_POSITION)).try_cast("int")


def truncated(value: Column) -> Column:
    return value.try_cast("int")


def lenient_int(text: Column) -> Column:
    """Leading integer of a text, else 0."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def fixed_decimals(value: Column, width: int, decimals: int) -> Column:
    return F.format_string(f"%{width}.{decimals}f", value.cast("double"))


def temperature_text(scaled: Column) -> Column:
    return _text_or_placeholder(F.format_string("%.2f °C", from_fixed_point(scaled)), scaled)


def humidity_text(scaled: Column) -> Column:
    return _text_or_placeholder(F.concat(_one_truncated_decimal(scaled), F.lit("  %")), scaled)


def pressure_text(pascal: Column) -> Column:
    return _text_or_placeholder(F.concat(_one_truncated_decimal(pascal), F.lit(" hPA")), pascal)


def _one_truncated_decimal(scaled: Column) -> Column:
    return F.format_string("%.1f", (scaled / F.lit(10)).cast("int") / F.lit(10.0))


def _text_or_placeholder(text: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), text).otherwise(F.lit(PLACEHOLDER))


def with_unit(text: Column, unit: str) -> Column:
    return F.concat(text, F.lit(f" {unit}"))


def age_text(seconds: Column) -> Column:
    """Minutes and seconds."""
    whole = seconds.cast("bigint")
    return F.format_string("%d:%02d", ((whole - whole % 60) / 60).cast("bigint"), whole % 60)


def mac_text(mac: Column) -> Column:
    """Six bytes as ``AA:BB:CC:DD:EE:FF``."""
    return F.regexp_replace(F.hex(mac), "(..)(?!$)", "$1:")


def date_text(time: Column) -> Column:
    return F.date_format(time, "E  dd-MM-yy HH:mm:ss")


def clock_text(time: Column) -> Column:
    return F.date_format(time, "HH:mm")


def local_time(time: Column, zone: str = "Europe/Berlin") -> Column:
    """Wall-clock time of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), time.cast("timestamp_ntz"))


def capability_text(caps: Column) -> Column:
    names = ["TempA", "Humi", "Volt", "Atmo", "TempB", "Light", "RGB", "Opt2", "Opt3"]
    parts = [F.concat(F.lit(f"{n}: "), has_capability(caps, n).cast("int").cast("string")) for n in names]
    return F.concat_ws(" ", *parts)


def mode_label(mode: Column) -> Column:
    return F.when(mode < AUTO_MODE, F.lit("MAN")).otherwise(F.lit("AUTO"))


def lora_source(code: Column) -> Column:
    """Name of a LoRa data source, ``unknown`` for any other number."""
    names = F.create_map(*[x for i, n in enumerate(LORA_SOURCES) for x in (F.lit(i), F.lit(n))])
    return F.coalesce(F.try_element_at(names, code), F.lit("unknown"))


def topic(channel: Column, field: Column) -> Column:
    return F.concat(F.lit("Sensor"), channel.cast("string"), F.lit("/"), field)
