"""Small dimension tables made from the fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.constants import ROLLUP_SPECS, SENSORS, TIERS


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table written as VALUES, so that Spark knows its size and can broadcast it by its own threshold."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def sensors(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ["channel", "static_caps", "batt_corr", "temp_a_corr", "temp_b_corr", "label"], SENSORS
    )


def tiers(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["tier", "duration_hours", "shard_hours"], TIERS)


def rollup_specs(spark: SparkSession, rows: list[tuple] = ROLLUP_SPECS) -> DataFrame:
    return literal_table(
        spark,
        ["name", "agg", "src_field", "dst_field", "src_tier", "dst_tier", "measurement", "width_s"],
        rows,
    )


def scheduled_specs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Definitions with their schedule, which may be missing: seconds from run to run and seconds that a run looks back."""
    columns = ["name", "agg", "src_field", "dst_field", "src_tier", "dst_tier", "measurement", "width_s", "every_s", "for_s"]
    table = literal_table(spark, columns, [(*row, None, None)[: len(columns)] for row in rows])
    return table.withColumns({c: table[c].cast("bigint") for c in columns[7:]})
