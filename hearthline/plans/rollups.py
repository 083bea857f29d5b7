"""Downsampling queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from hearthline.constants import LONG_HOP_SPECS, ROLLUP_SPECS
from hearthline.operators import rollup as R
from hearthline.operators.definitions import run_definitions
from hearthline.plans.registry import query
from hearthline.plans.views import TAGGED_POINTS, Views
from hearthline.session import work_dir
from hearthline.sources import dims
from hearthline.sources.points_store import append_points, read_newest

# Means are compared to this many digits, since the order of a floating-point sum is free.
DIGITS = 6


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) for c in (columns or ("value",))})


def _bucketed(agg: str, width_s: int, extra: str = "") -> str:
    return (
        f"SELECT tier, measurement, field, time_bucket(INTERVAL '{width_s} seconds', time) AS time, "
        f"round({agg}, {DIGITS}) AS value FROM {{points}} {extra} GROUP BY ALL"
    )


def _register_means() -> None:
    for label, width_s in (("5m", 300), ("30m", 1800), ("1h", 3600), ("2h", 7200), ("1d", 86400)):
        query(f"rollup_mean_{label}", _bucketed("avg(value)", width_s))(
            lambda v, width_s=width_s: rounded(R.rollup(v.points, "mean", width_s))
        )


_register_means()


@query("rollup_max", _bucketed("max(value)", 3600))
def rollup_max(v: Views):
    return R.rollup(v.points, "max", 3600)


@query("rollup_min", _bucketed("min(value)", 3600))
def rollup_min(v: Views):
    return R.rollup(v.points, "min", 3600)


@query(
    "rollup_star",
    " UNION ALL ".join(
        f"SELECT tier, measurement, '{a}_' || field AS field, time_bucket(INTERVAL '1 day', time) AS time, "
        f"{a}(value) AS value FROM {{points}} GROUP BY ALL"
        for a in ("min", "max")
    ),
)
def rollup_star(v: Views):
    return R.rollup_star(v.points, ("min", "max"), 86400)


@query(
    "rollup_last",
    """
    SELECT tier, measurement, field, bucket AS time, value FROM (
        SELECT *, time_bucket(INTERVAL '1 hour', time) AS bucket,
               row_number() OVER (PARTITION BY tier, measurement, field, time_bucket(INTERVAL '1 hour', time)
                                  ORDER BY time DESC, write_seq DESC) AS rn
        FROM {points}) WHERE rn = 1
    """,
)
def rollup_last(v: Views):
    return R.rollup(v.points, "last", 3600)


@query(
    "rollup_distinct",
    "SELECT DISTINCT measurement, field, time_bucket(INTERVAL '1 minute', time) AS time, value FROM {points}",
)
def rollup_distinct(v: Views):
    return R.rollup_distinct(v.points, 60, ("measurement", "field"))


@query(
    "mean_range",
    f"SELECT tier, measurement, field, round(avg(value), {DIGITS}) AS mean FROM {{points}} GROUP BY ALL",
)
def mean_range(v: Views):
    return rounded(R.mean_range(v.points), "mean")


@query(
    "rollup_multi",
    f"""
    SELECT tier, measurement, time_bucket(INTERVAL '5 minutes', time) AS time,
           round(avg(value) FILTER (WHERE field = 'fTempA'), {DIGITS}) AS "fTempA",
           max(value) FILTER (WHERE field = 'fTempA') AS "fTempAMax",
           min(value) FILTER (WHERE field = 'fTempA') AS "fTempAMin",
           round(avg(value) FILTER (WHERE field = 'fHumi'), {DIGITS}) AS "fHumi"
    FROM {{points}} WHERE field IN ('fTempA', 'fHumi') GROUP BY ALL
    """,
)
def rollup_multi(v: Views):
    aggs = {
        "fTempA": ("mean", "fTempA"),
        "fTempAMax": ("max", "fTempA"),
        "fTempAMin": ("min", "fTempA"),
        "fHumi": ("mean", "fHumi"),
    }
    return rounded(R.rollup_wide(v.points, aggs, 300), "fTempA", "fHumi")


@query(
    "rollup_by_tags",
    f"""
    SELECT tier, measurement, field, node, time_bucket(INTERVAL '1 hour', time) AS time,
           round(avg(value), {DIGITS}) AS value
    FROM {{tagged_points}} GROUP BY ALL
    """,
)
def rollup_by_tags(v: Views):
    return rounded(R.rollup_by_tags(v.over_events(TAGGED_POINTS), "mean", 3600))


@query(
    "rollup_round2",
    """
    SELECT tier, measurement, field, time_bucket(INTERVAL '5 minutes', time) AS time,
           round(avg(value) * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS value
    FROM {points} GROUP BY ALL
    """,
)
def rollup_round2(v: Views):
    return R.rollup(v.points, "mean", 300).withColumn("value", R.round2(F.col("value")))


_CASCADE = """
    WITH five AS (SELECT tier, measurement, field, time_bucket(INTERVAL '5 minutes', time) AS time, avg(value) AS value,
                         sum(value) AS s, count(value) AS n FROM {points} GROUP BY ALL),
         hour AS (SELECT tier, measurement, field, time_bucket(INTERVAL '1 hour', time) AS time, avg(value) AS value,
                         sum(s) AS s, sum(n) AS n FROM five GROUP BY ALL)
"""


@query(
    "rollup_cascade",
    _CASCADE
    + f"SELECT tier, measurement, field, time_bucket(INTERVAL '1 day', time) AS time, "
    f"round(avg(value), {DIGITS}) AS value FROM hour GROUP BY ALL",
)
def rollup_cascade(v: Views):
    return rounded(R.cascade(v.points, (300, 3600, 86400)))


@query(
    "rollup_cascade_weighted",
    _CASCADE
    + f"SELECT tier, measurement, field, time_bucket(INTERVAL '1 day', time) AS time, "
    f"round(sum(s) / sum(n), {DIGITS}) AS value, CAST(sum(n) AS BIGINT) AS n FROM hour GROUP BY ALL",
)
def rollup_cascade_weighted(v: Views):
    return rounded(R.cascade_weighted(v.points, (300, 3600, 86400)))


@query("error_rate", _bucketed("avg(value)", 3600, "WHERE field IN ('Err', 'ERR')"))
def error_rate(v: Views):
    return rounded(R.rollup(v.points.where(F.col("field").isin("Err", "ERR")), "mean", 3600))


@query(
    "rollup_self_field",
    f"""
    SELECT tier, measurement, field, time, value FROM {{points}}
    UNION ALL
    SELECT tier, measurement, field || 'Test' AS field, time_bucket(INTERVAL '5 minutes', time) AS time,
           round(avg(value), {DIGITS}) AS value
    FROM {{points}} GROUP BY ALL
    """,
)
def rollup_self_field(v: Views):
    points = v.points
    means = rounded(R.rollup(points, "mean", 300)).withColumn("field", F.concat("field", F.lit("Test")))
    return points.drop("write_seq").unionByName(means)


def _by_specs(view: str, specs: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in specs)
    return f"""
    SELECT s.name, s.dst_tier AS tier, p.measurement, s.dst_field AS field,
           make_timestamp((epoch_us(p.time) // (CAST(s.width_s AS BIGINT) * 1000000)) * s.width_s * 1000000) AS time,
           round(avg(p.value), {DIGITS}) AS value
    FROM {{{view}}} p JOIN (VALUES {values})
         s(name, agg, src_field, dst_field, src_tier, dst_tier, measurement, width_s)
      ON p.tier = s.src_tier AND p.measurement = s.measurement AND p.field = s.src_field
    GROUP BY ALL
    """


@query("rollup_all_specs", _by_specs("points", ROLLUP_SPECS))
def rollup_all_specs(v: Views):
    return rounded(R.rollup_by_specs(v.points, dims.rollup_specs(v.spark)))


@query("rollup_definitions", _by_specs("spec_points", ROLLUP_SPECS))
def rollup_definitions(v: Views):
    """The same over points that feed every definition."""
    return rounded(R.rollup_by_specs(v.spec_points, dims.rollup_specs(v.spark)))


@query("rollup_long_hop", _by_specs("spec_points", LONG_HOP_SPECS))
def rollup_long_hop(v: Views):
    """Definitions that skip a tier."""
    return rounded(R.rollup_by_specs(v.spec_points, dims.rollup_specs(v.spark, LONG_HOP_SPECS)))


_SPECS = [*ROLLUP_SPECS, *LONG_HOP_SPECS]
#: Numbers of the writes of the first and of the second run, above those of all points.
_RUN_1, _RUN_2 = 10**12, 2 * 10**12
#: Seconds that a run looks back where a definition says so; the others take one bucket.
_SCHEDULES = {"cq_5min_S2_fTempA": (3600, 21_600), "cq_1hour_S2_fTempA": (3600, 86_400), "cq_5min_S5_fHumi": (1800, 7200)}
_SCHEDULED = [(*row, *_SCHEDULES.get(row[0], (None, None))) for row in _SPECS]


def _levels() -> list[list[tuple]]:
    """Definitions by the longest way from a source that no definition writes."""
    written = {(s[5], s[6], s[3]): [t for t in _SPECS if (t[5], t[6], t[3]) == (s[5], s[6], s[3])] for s in _SPECS}

    def level(s: tuple) -> int:
        return 1 + max([level(t) for t in written.get((s[4], s[6], s[2]), [])], default=-1)

    out: list[list[tuple]] = [[] for _ in range(max(map(level, _SPECS)) + 1)]
    for s in sorted(_SCHEDULED):
        out[level(s)].append(s)
    return out


def _into_tiers_sql() -> str:
    """Two runs, each level after level: a store is a table of newest writes, to which a level adds its own."""
    key = "tier, measurement, time, field"
    store = f"SELECT {key}, arg_max(value, seq) AS value, max(seq) AS seq FROM ({{}}) GROUP BY ALL"
    points = f"SELECT {key}, value, write_seq AS seq FROM {{spec_points}} WHERE write_seq % 13 {{}} 0"
    steps = ["now_ AS (SELECT (epoch_us(max(ts)) // 3600000000 + 1) * 3600 AS s FROM events)"]
    steps.append("s0 AS MATERIALIZED (" + store.format(points.replace("{}", "<>")) + ")")
    at = 0

    def add(rows: str) -> None:
        nonlocal at
        steps.append(f"s{at + 1} AS MATERIALIZED (" + store.format(f"SELECT * FROM s{at} UNION ALL {rows}") + ")")
        at += 1

    for first in (_RUN_1, _RUN_2):
        number = first
        if first == _RUN_2:
            add(points.replace("{}", "="))
        # numbers count the definitions that run, and which of them are due depends on the newest point
        for level in _levels():
            values = []
            for row in level:
                every = row[8] or row[7]
                values.append("(" + ", ".join(repr(x) for x in (*row[:8], every, row[9] or max(every, row[7]), number)) + ")")
                number += 1
            window = ""
            if first == _RUN_2:
                window = (
                    "AND (SELECT s FROM now_) % d.every_s = 0 AND epoch_us(p.time) < (SELECT s FROM now_) * 1000000 AND epoch_us(p.time) "
                    "// 1000000 >= ((SELECT s FROM now_) - d.for_s) // d.width_s * d.width_s"
                )
            add(
                f"""
                SELECT d.dst_tier AS tier, p.measurement, make_timestamp((epoch_us(p.time) // (CAST(d.width_s AS BIGINT) * 1000000))
                       * d.width_s * 1000000) AS time, d.dst_field AS field, avg(p.value) AS value, d.seq AS seq
                FROM s{at} p JOIN (VALUES {', '.join(values)})
                     d(name, agg, src_field, dst_field, src_tier, dst_tier, measurement, width_s, every_s, for_s, seq)
                  ON p.tier = d.src_tier AND p.measurement = d.measurement AND p.field = d.src_field {window}
                GROUP BY ALL
                """
            )
    return f"WITH {', '.join(steps)} SELECT {key}, round(value, {DIGITS}) AS value FROM s{at}"


@query("rollup_into_tiers", _into_tiers_sql())
def rollup_into_tiers(v: Views):
    """All definitions and long hops into the store, over everything; then late points and a run at the next full hour."""
    root = work_dir(v.spark, "rollup_into_tiers") + "/points"
    specs = dims.scheduled_specs(v.spark, _SCHEDULED)
    late = F.col("write_seq") % 13 == 0
    append_points(v.spec_points.where(~late), root)
    run_definitions(v.spark, root, specs, write_seq=_RUN_1)
    append_points(v.spec_points.where(late), root)
    newest = v.events.agg(F.max("ts").alias("ts")).first()["ts"]
    if newest is not None:
        now = newest.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
        run_definitions(v.spark, root, specs, now=now, write_seq=_RUN_2)
    return rounded(read_newest(v.spark, root).select("tier", "measurement", "time", "field", "value"))


@query(
    "resample_window",
    f"""
    SELECT tier, measurement, field,
           time_bucket(INTERVAL '1 hour', time) + INTERVAL '1 hour' AS run_at,
           time_bucket(INTERVAL '30 minutes', time) AS time, round(avg(value), {DIGITS}) AS value
    FROM {{points}} GROUP BY ALL
    """,
)
def resample_window(v: Views):
    return rounded(R.resample(v.points, "mean", 1800, every_s=3600, span_s=3600))


@query(
    "resample_overlapping",
    f"""
    WITH runs AS (SELECT *, time_bucket(INTERVAL '1 hour', time) + INTERVAL '1 hour' AS run_at FROM {{points}}
                  UNION ALL
                  SELECT *, time_bucket(INTERVAL '1 hour', time) + INTERVAL '2 hours' AS run_at FROM {{points}})
    SELECT tier, measurement, field, run_at, time_bucket(INTERVAL '5 minutes', time) AS time,
           round(avg(value), {DIGITS}) AS value
    FROM runs GROUP BY ALL
    """,
)
def resample_overlapping(v: Views):
    """``RESAMPLE EVERY 1h FOR 2h``: every bucket is computed by two runs."""
    return rounded(R.resample(v.points, "mean", 300, every_s=3600, span_s=7200))


@query(
    "resample_final",
    f"""
    SELECT tier, measurement, field, time_bucket(INTERVAL '1 hour', time) AS time, round(avg(value), {DIGITS}) AS value
    FROM {{points}} GROUP BY ALL
    """,
)
def resample_final(v: Views):
    """``RESAMPLE EVERY 30m FOR 90m`` over hours: spans cut buckets, and after all runs the whole buckets are stored."""
    return rounded(R.latest_only(R.resample(v.points, "mean", 3600, every_s=1800, span_s=5400)))
