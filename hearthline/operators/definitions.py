"""Rollup definitions that run into the stored tiers: each reads what the ones it depends on have written."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.rollup import SPEC_AGGREGATES, rollup_by_specs
from hearthline.sources.dims import literal_table
from hearthline.sources.points_store import append_points, read_newest


def with_schedule(specs: DataFrame) -> DataFrame:
    """``every_s`` and ``for_s`` where a definition has none: it runs once per bucket and looks back over one run."""
    every = F.coalesce("every_s", "width_s")
    return specs.withColumns({"every_s": every, "for_s": F.coalesce("for_s", F.greatest(every, "width_s"))})


def levels(specs: Sequence[Row]) -> list[list[Row]]:
    """Definitions by level: each reads only what is stored beforehand or written by lower levels; by name inside a level.

    A definition may write into its own source. Others that feed each other in a circle have no order: an error.
    """
    writers: dict[tuple, list[Row]] = {}
    for s in specs:
        writers.setdefault((s["dst_tier"], s["measurement"], s["dst_field"]), []).append(s)
    feeds = {
        s["name"]: [w["name"] for w in writers.get((s["src_tier"], s["measurement"], s["src_field"]), []) if w["name"] != s["name"]]
        for s in specs
    }
    if len(feeds) < len(specs):
        raise ValueError("two definitions have one name")
    level: dict[str, int] = {}
    while len(level) < len(feeds):
        ready = [n for n, before in feeds.items() if n not in level and all(b in level for b in before)]
        if not ready:
            raise ValueError(f"definitions feed each other: {sorted(set(feeds) - set(level))}")
        level |= {n: 1 + max((level[b] for b in feeds[n]), default=-1) for n in ready}
    out: list[list[Row]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for s in sorted(specs, key=lambda s: s["name"]):
        out[level[s["name"]]].append(s)
    return out


def run_definitions(
    spark: SparkSession, root: str, specs: DataFrame, now: datetime | None = None, write_seq: int | None = None
) -> int:
    """Run definitions (columns of ``dims.scheduled_specs``) into the store below ``root``; how many ran.

    Without ``now`` all of them run over all that is stored. With it (UTC), those run whose ``every_s`` divides it, and each
    recomputes the whole buckets that touch the last ``for_s`` seconds from points before ``now``; only the days these lie in
    are read. A level is one scan, one exchange and one append. Writes are numbered from ``write_seq`` on (default: the
    clock's microsecond, as streams do), later levels and names higher, so that of two definitions that write one key the
    later one is in force. Repeating a run stores the same values again.
    """
    # one row per definition
    known = with_schedule(specs).collect()
    wrong = [s["name"] for s in known if s["agg"] not in SPEC_AGGREGATES or not s["width_s"] or s["width_s"] < 1]
    if wrong:
        raise ValueError(f"no such aggregate or width: {wrong}")
    second = None if now is None else int(now.replace(tzinfo=UTC).timestamp())
    number = time.time_ns() // 1000 if write_seq is None else write_seq
    ran = 0
    for level in levels(known):
        due = [s for s in level if second is None or second % s["every_s"] == 0]
        if not due:
            continue
        starts = {s["name"]: None if second is None else (second - s["for_s"]) // s["width_s"] * s["width_s"] for s in due}
        t0 = None if second is None else datetime.fromtimestamp(min(starts.values()), UTC).replace(tzinfo=None)
        points = read_newest(spark, root, sorted({s["src_tier"] for s in due}), t0, now)
        if now is not None:
            points = points.where(F.col("time") < F.lit(now).cast("timestamp_ntz"))
        columns = [c for c in specs.columns if c not in ("every_s", "for_s")]
        made = rollup_by_specs(points, literal_table(spark, columns, [tuple(s[c] for c in columns) for s in due]))
        numbered = [(s["name"], number + ran + k, starts[s["name"]]) for k, s in enumerate(due)]
        seqs = literal_table(spark, ["name", "write_seq", "from_s"], numbered)
        whole = F.col("from_s").isNull() | (F.unix_seconds(F.col("time").cast("timestamp")) >= F.col("from_s"))
        rows = made.join(seqs, "name").where(whole & F.col("value").isNotNull())
        append_points(rows.select("tier", "measurement", "time", "field", "value", F.col("write_seq").cast("bigint")), root)
        ran += len(due)
    return ran
