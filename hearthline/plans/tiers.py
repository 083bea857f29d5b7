"""Selection, copying, deletion and retention queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hearthline.constants import TIERS
from hearthline.operators import tiers as T
from hearthline.plans.registry import query
from hearthline.plans.views import SPECS_CREATED, SPECS_DROPPED, TIER_LOG, Views
from hearthline.session import work_dir
from hearthline.sources import dims
from hearthline.sources import points_store as store

POINT = "tier, measurement, time, field, value, write_seq"


@query(
    "scan_points",
    f"SELECT {POINT} FROM {{points}} WHERE tier = 'one_year' AND measurement = 'sSens1' AND field IN ('fTempA', 'fHumi')",
)
def scan_points(v: Views):
    return T.scan_points(v.points, "one_year", "sSens1", ["fTempA", "fHumi"])


@query(
    "scan_tiers",
    f"SELECT {POINT} FROM {{points}} WHERE tier IN ('autogen', 'two_month', 'one_year') AND measurement = 'sSens2'",
)
def scan_tiers(v: Views):
    return T.scan_tiers(v.points, ["autogen", "two_month", "one_year"], "sSens2")


@query(
    "time_range",
    f"SELECT {POINT} FROM {{points}} WHERE time >= TIMESTAMP '2024-01-05 12:45:00' "
    "AND time <= TIMESTAMP '2024-01-20 12:55:00'",
)
def time_range(v: Views):
    return T.time_range(v.points, datetime(2024, 1, 5, 12, 45), datetime(2024, 1, 20, 12, 55))


@query(
    "time_relative",
    f"SELECT {POINT} FROM {{points}} WHERE time > (SELECT max(ts) FROM events) - INTERVAL 10 DAYS "
    "AND time < (SELECT max(ts) FROM events) - INTERVAL 20 MINUTES",
)
def time_relative(v: Views):
    newest = v.points.agg(F.max("time")).scalar()
    return T.time_relative(v.points, newest, "10 days", "20 minutes")


@query(
    "upsert_points",
    """
    WITH written AS (
        SELECT * FROM {points}
        UNION ALL
        SELECT tier, measurement, time, field, value + 1 AS value, write_seq + 1000000000000 AS write_seq
        FROM {points} WHERE field <> 'Err'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tier, measurement, time, field ORDER BY write_seq DESC) AS rn
               FROM written)
    SELECT tier, measurement, time, field, value, write_seq FROM ranked WHERE rn = 1
    """,
)
def upsert_points(v: Views):
    points = v.points
    again = points.where("field <> 'Err'").withColumns(
        {"value": F.col("value") + 1, "write_seq": F.col("write_seq") + F.lit(10**12)}
    )
    return T.upsert(points, again)


_STORE_RUN = 10**12


@query(
    "store_upsert",
    f"""
    WITH written AS (
        SELECT * FROM {{points}}
        UNION ALL
        SELECT tier, measurement, time, field, value + 1, write_seq + {_STORE_RUN} FROM {{points}} WHERE write_seq % 5 = 0
        UNION ALL
        SELECT tier, measurement, time, field, value + 2, write_seq + 2 * {_STORE_RUN} FROM {{points}} WHERE write_seq % 7 = 0
        UNION ALL
        SELECT tier, measurement, time, field, value - 1, write_seq - {_STORE_RUN} FROM {{points}}
        WHERE epoch_us(time) >= (SELECT epoch_us(max(ts)) FROM events) - 86400000000),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tier, measurement, time, field ORDER BY write_seq DESC) AS rn
               FROM written)
    SELECT tier, measurement, time, field, value, write_seq FROM ranked WHERE rn = 1
    """,
)
def store_upsert(v: Views):
    """Writes appended to the store as they come, also older ones; some days are compacted in between."""
    points, root = v.points, work_dir(v.spark, "store_upsert") + "/points"

    def again(seq: int, by: int):
        return points.withColumns({"value": F.col("value") + by, "write_seq": F.col("write_seq") + F.lit(seq).cast("bigint")})

    store.append_points(points, root)
    store.append_points(again(_STORE_RUN, 1).where("write_seq % 5 = 0"), root)
    store.compact_days(v.spark, root)
    store.append_points(again(2 * _STORE_RUN, 2).where(f"(write_seq - {2 * _STORE_RUN}) % 7 = 0"), root)
    newest = v.events.agg(F.max("ts")).scalar()
    store.append_points(again(-_STORE_RUN, -1).where(F.col("time") >= newest - F.expr("INTERVAL 1 DAY")), root)
    return store.read_newest(v.spark, root).select("tier", "measurement", "time", "field", "value", "write_seq")


@query(
    "backfill_copy",
    """
    SELECT 'one_year' AS tier, measurement, time, field, value, write_seq FROM {points}
    WHERE tier = 'autogen' AND field = 'fTempA'
      AND time >= make_timestamp(1704200000000 * 1000) AND time <= make_timestamp(1706400000000 * 1000)
    """,
)
def backfill_copy(v: Views):
    return T.backfill(v.points, "autogen", "one_year", "fTempA", T.millis(1704200000000), T.millis(1706400000000))


@query(
    "backfill_chunks",
    """
    SELECT 'one_year' AS tier, measurement, time, field, value,
           CAST(floor(date_diff('day', DATE '1995-01-01', CAST(time AS DATE)) / 70.0) AS BIGINT) AS chunk
    FROM {points_long} WHERE tier = 'two_month'
    """,
)
def backfill_chunks(v: Views):
    return T.backfill_chunks(v.points_long, "two_month", "one_year", datetime(1995, 1, 1), weeks=10)


@query(
    "delete_range",
    f"""
    SELECT {POINT} FROM {{points}} WHERE NOT (measurement = 'sSens3'
        AND time >= TIMESTAMP '2024-01-10 12:45:00' AND time <= TIMESTAMP '2024-01-15 12:55:00')
    """,
)
def delete_range(v: Views):
    return T.delete_range(v.points, "sSens3", datetime(2024, 1, 10, 12, 45), datetime(2024, 1, 15, 12, 55))


_TIER_VALUES = ", ".join(f"('{t}', {'NULL' if h is None else h})" for t, h, _ in TIERS)


@query(
    "retention_expire",
    f"""
    SELECT p.tier, p.measurement, p.time, p.field, p.value
    FROM {{points_long}} p LEFT JOIN (VALUES {_TIER_VALUES}) d(tier, hours) ON p.tier = d.tier
    WHERE d.hours IS NULL OR p.time >= (SELECT max(l_shipdate) FROM lineitem) - d.hours * INTERVAL '1 hour'
    """,
)
def retention_expire(v: Views):
    newest = v.points_long.agg(F.max("time")).scalar()
    return T.expire(v.points_long, dims.tiers(v.spark), newest)


@query("drop_tier", f"SELECT {POINT} FROM {{points}} WHERE tier <> 'two_month'")
def drop_tier(v: Views):
    return T.drop_tier(v.points, "two_month")


@query(
    "tiers_current",
    r"""
    WITH parsed AS (
        SELECT tier, seq, TRY_CAST(regexp_extract(duration, '^(\d+)', 1) AS BIGINT)
               * CASE WHEN regexp_matches(duration, '^\d+w') THEN 168 WHEN regexp_matches(duration, '^\d+d') THEN 24
                      WHEN regexp_matches(duration, '^\d+h') THEN 1 END AS hours
        FROM {tier_log}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY seq DESC) AS rn FROM parsed)
    SELECT tier, CAST(CASE WHEN hours > 0 THEN hours END AS BIGINT) AS duration_hours, seq FROM ranked WHERE rn = 1
    """,
)
def tiers_current(v: Views):
    return T.current_tiers(v.over_events(TIER_LOG))


@query(
    "specs_after_drop",
    """
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM {specs_created})
    SELECT name, agg, width_s, seq FROM ranked r WHERE rn = 1
      AND NOT EXISTS (SELECT 1 FROM {specs_dropped} d WHERE d.name = r.name AND d.seq > r.seq)
    """,
)
def specs_after_drop(v: Views):
    def log(types: str, view: dict[str, str]):
        return v.events.where(f"event_type IN ({types})").selectExpr(*[f"{e} AS {n}" for n, e in view.items()])

    return T.current_specs(log("'click', 'view'", SPECS_CREATED), log("'error'", SPECS_DROPPED))
