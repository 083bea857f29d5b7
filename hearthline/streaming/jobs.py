"""Structured Streaming jobs: continuous rollups, late data, sampling, silence alarms.

The transformations are the batch operators; a job adds the watermark, the sink and the trigger.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthline.constants import AUTO_MODE, DEFAULT_SET_POINT
from hearthline.operators.control import set_point_in_force
from hearthline.operators.health import sample_last
from hearthline.operators.ordered import micros, order_key
from hearthline.operators.rollup import SERIES, rollup
from hearthline.operators.tiers import into
from hearthline.session import ship
from hearthline.sources.points_store import append_points, compact_days


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything there is and stop; closed windows are appended to a Parquet folder, exactly once."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: A time after every window; pandas knows times up to 2262.
END = datetime(2250, 1, 1)


def run_to_end(
    transform: Callable[[DataFrame], DataFrame],
    source: DataFrame,
    event_time: str,
    output: str,
    work: str,
    until: datetime = END,
    marker: dict[str, object] | None = None,
) -> DataFrame:
    """Run over a finished source and give what its state still holds: no window stays open for want of a later row.

    After everything is processed, one row with ``until`` as its event time, and nothing else but ``marker``, passes through a
    second input of the same query; it moves the watermark past all that is open, and what it opens itself is never given.
    ``transform`` sets the watermark and must let that row reach it. The stream is returned, for ``read_output``. Rows that
    arrive afterwards are late.
    """
    stream = run_open(transform, source, output, work)
    row = {event_time: until, **(marker or {})}
    last = source.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in source.schema.fields])
    last.write.mode("append").parquet(f"{work}/end")
    run_available(stream, output, f"{work}/checkpoint")
    return stream


def run_open(transform: Callable[[DataFrame], DataFrame], source: DataFrame, output: str, work: str) -> DataFrame:
    """``run_available`` of a query that ``run_to_end`` will close: its second input is there, and empty."""
    spark = source.sparkSession
    spark.createDataFrame([], source.schema).write.mode("ignore").parquet(f"{work}/end")
    stream = transform(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{work}/end")))
    run_available(stream, output, f"{work}/checkpoint")
    return stream


def run_continuously(stream: DataFrame, output: str, checkpoint: str, every: str = "5 minutes"):
    """The same sink on a schedule (``RESAMPLE EVERY``); returns the running query."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def read_output(spark: SparkSession, stream: DataFrame, output: str) -> DataFrame:
    """What the job has stored so far; the schema is known even if nothing is."""
    return spark.read.schema(stream.schema).parquet(output)


def rollup_stream(points: DataFrame, agg: str, width_s: int, late: str = "2 hours", by=SERIES) -> DataFrame:
    """Continuous rollup. Points up to ``late`` behind the newest still count; a bucket is written once, when closed."""
    return rollup(points.withWatermark("time", late), agg, width_s, by)


def run_into_tier(stream: DataFrame, root: str, tier: str, checkpoint: str, compact: bool = True) -> None:
    """Store what each trigger changed as points of a tier, newest write first in force.

    Writes are numbered by the microsecond of their commit, so that a bucket which late points changed, or a repeated
    trigger, replaces what was stored before, whoever wrote that. Batch writers number below that or by the same clock.
    A trigger appends its own rows only; the days they fall in are rewritten once at the end, or, without ``compact``, whenever
    ``points_store.compact_days`` is run (``read_newest`` reads the store at any time).
    """

    def store(changed: DataFrame, number: int) -> None:
        rows = into(changed, tier).select(
            "tier",
            "measurement",
            F.col("time").cast("timestamp_ntz").alias("time"),
            "field",
            "value",
            F.lit(time.time_ns() // 1000).cast("bigint").alias("write_seq"),
        )
        append_points(rows, root)

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if compact:
        compact_days(stream.sparkSession, root)


def sample_stream(readings: DataFrame, width_s: int = 15, late: str = "1 minute") -> DataFrame:
    return sample_last(readings.withWatermark("ts", late), width_s)


def silence_stream(readings: DataFrame, limit_s: int, late: str = "10 minutes", key: str = "channel") -> DataFrame:
    """Silence alarms as the closing of sessions.

    A session of readings ends once the sensor has been silent for longer than the limit: that is the alarm. The
    window is a microsecond longer than the limit, for a gap of exactly the limit is no silence. Sensors without any
    capability raise no alarm. Each reading after a silence opens the next session, which clears the alarm; ``alarm_stream``
    says when, and repeats the alarm until then.
    """
    sessions = (
        readings.where(F.col("caps") != 0)
        .withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", f"{limit_s} seconds 1 microsecond").alias("_session"))
        .agg(F.max("ts").alias("silent_from"), F.count("*").alias("readings"))
    )
    return sessions.select(
        F.col(key),
        F.col("_session.start").alias("heard_from"),
        "silent_from",
        (F.col("silent_from") + F.make_dt_interval(secs=F.lit(limit_s))).alias("alarm_at"),
        "readings",
        F.concat(F.lit("Sensor"), F.col(key).cast("string"), F.lit("/Err")).alias("topic"),
        F.lit("1").alias("payload"),
    )


def alarm_stream(readings: DataFrame, limit_s: int, every_s: int, late: str = "10 minutes", key: str = "channel") -> DataFrame:
    """Alarms of silent sensors as they fall due: (key, ts, topic, payload).

    Payload 1 once a sensor has been silent for the limit, again every ``every_s`` while it stays so, and 0 at the reading
    that ends the silence. Keyed state with an event-time timer: a row is given when the watermark has reached its time, so
    readings up to ``late`` behind the newest are taken in order and nothing is taken back. The state of a sensor is the
    end of what was heard last, the alarm that is due next, and first and last reading of the stretches heard since.
    """
    limit, every = limit_s * 1_000_000, every_s * 1_000_000
    kind = readings.schema[key].dataType

    def advance(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, due, heard = state.get if state.exists else (None, None, [])
        new = [] if state.hasTimedOut else [p["at"].to_numpy(dtype=np.int64) for p in parts]
        first, final = _stretches(np.array(heard, np.int64), np.concatenate([np.zeros(0, np.int64), *new]), limit)
        upto = state.getCurrentWatermarkMs() * 1000
        out: list[tuple[int, str]] = []

        def alarms(until: int) -> None:
            nonlocal due
            if due is not None and due <= until:
                n = (until - due) // every + 1
                out.extend((due + k * every, "1") for k in range(n))
                due += n * every

        settled = int(np.searchsorted(first, upto, side="right"))
        for begin, end in zip(first[:settled].tolist(), final[:settled].tolist()):
            if last is not None and begin - last > limit:
                alarms(begin)
                out.append((begin, "0"))
            if last is None or end > last:
                # a stretch that the watermark cuts has no silence in it: its end counts at once
                last, due = end, end + limit
        alarms(upto)
        first, final = first[settled:], final[settled:]
        state.update((last, due, np.stack([first, final], axis=1).ravel().tolist()))
        wake = min([t for t in (due, *first[:1].tolist()) if t is not None])
        state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, upto // 1000 + 1))
        if out:
            yield pd.DataFrame(
                {
                    key: [name[0]] * len(out),
                    "ts": pd.to_datetime([t for t, _ in out], unit="us", utc=True),
                    "topic": f"Sensor{name[0]}/Err",
                    "payload": [p for _, p in out],
                }
            )

    schema = T.StructType([T.StructField(key, kind), T.StructField("ts", T.TimestampType()), T.StructField("topic", T.StringType()), T.StructField("payload", T.StringType())])
    ship(readings.sparkSession)
    timed = readings.where(F.col("caps") != 0).withWatermark("ts", late).select(key, "ts", micros(F.col("ts")).alias("at"))
    alarms = timed.groupBy(key).applyInPandasWithState(
        advance, schema, "last bigint, due bigint, heard array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return alarms.where(F.col(key).isNotNull())


def _stretches(known: np.ndarray, times: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts of the stretches without a silence, from those known (first, last, first, ...) and single readings."""
    first, last = np.concatenate([known[::2], times]), np.concatenate([known[1::2], times])
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    begins = np.flatnonzero(np.concatenate([[True], first[1:] - upto[:-1] > limit])) if len(first) else np.zeros(0, np.int64)
    return first[begins], upto[np.append(begins[1:], len(first)) - 1] if len(first) else upto


def frame_stream(log: DataFrame, key: str = "port", width: int = 1 << 16) -> DataFrame:
    """Frames of a port's log (key, seq, text) whose text comes in any pieces, also cut between triggers: (key, seq, payload).

    Equal to ``split_frames_across_rows``: ``seq`` is that of the row in which a frame ends. Rows of a port must arrive in the
    order of ``seq`` from trigger to trigger.

    In each trigger slices of ``width`` numbers of a port are put together side by side, and frames between two end markers
    of a slice are given at once. Only the edge of a slice, its text up to the first end marker and what is open after the last
    one, goes to the port's task; what the port has open, the text after a start marker, is the state of its key. So a task
    holds some slices, or the edges of a port, however long its log is. ``width`` changes how the work is cut, never the result.
    """
    kind = log.schema[key].dataType
    frame = T.StructType([T.StructField(key, kind), T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType())])
    edge = T.StructType([T.StructField(key, kind), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])

    def inner(slice_: pa.Table) -> tuple[list, list]:
        text, ends = _joined(slice_)
        begin, end = text.find("$") + 1, text.rfind("$") + 1
        found = list(_FRAME.finditer(text, begin, end)) if 0 < begin < end else []
        at = np.searchsorted(ends, np.array([m.end() for m in found], np.int64))
        return slice_.column("seq").take(pa.array(at)).to_pylist(), [m[1] for m in found]

    def outer(slice_: pa.Table) -> tuple[list, list]:
        text, ends = _joined(slice_)
        begin, tail = text.find("$") + 1, text[text.rfind("$") + 1 :]
        if not begin:
            return slice_.column("seq")[-1:].to_pylist(), [text]
        opened = tail.find("%")
        at = int(np.searchsorted(ends, begin))
        return slice_.column("seq")[at : at + 1].to_pylist(), [text[:begin] + (tail[opened:] if opened >= 0 else "")]

    def advance(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([p[["seq", "text"]] for p in parts]).sort_values("seq", kind="stable")
        begun = state.get[0] if state.exists else None
        before = "" if begun is None else "%" + begun
        text = before + "".join(rows["text"])
        ends = len(before) + np.cumsum(rows["text"].str.len().to_numpy(dtype=np.int64))
        found = list(_FRAME.finditer(text))
        opened = text.find("%", text.rfind("$") + 1)
        state.update((None if opened < 0 else text[opened + 1 :],))
        if found:
            seqs = [int(x) for x in rows["seq"].to_numpy()[np.searchsorted(ends, [m.end() for m in found])]]
            yield pd.DataFrame({key: [name[0]] * len(found), "seq": seqs, "payload": [m[1] for m in found]})

    ship(log.sparkSession)
    slices = log.select(key, F.col("seq").cast("bigint").alias("seq"), F.floor(F.col("seq") / width).alias("slice"), "text").where(F.col("text").isNotNull())
    parts = max(_SLICE_PARTS, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = slices.repartition(parts, key, "slice")
    inside = dealt.mapInArrow(_by_slice(inner, frame.names), frame)
    edges = dealt.mapInArrow(_by_slice(outer, edge.names), edge)
    across = edges.groupBy(key).applyInPandasWithState(advance, frame, "begun string", "append", GroupStateTimeout.NoTimeout)
    return inside.unionByName(across)


def _by_slice(cut: Callable[[pa.Table], tuple[list, list]], names: list[str]) -> Callable:
    """For each slice of a key, its rows in order, the rows (key, seq, text) that ``cut`` gives of it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not sum(b.num_rows for b in own):
            return
        rows = pa.Table.from_batches(own)
        own.clear()
        rows = rows.set_column(3, "text", rows.column(3).cast(pa.large_string()))
        # the text last, so that rows of one number have one order in all passes
        order = pc.sort_indices(rows, [(name, "ascending") for name in (rows.column_names[0], "slice", "seq", "text")])
        rows = rows.take(order).combine_chunks()
        new = np.zeros(len(rows) - 1, bool)
        for column in (rows.column(0), rows.column("slice")):
            codes = column.combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        first = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(first, [*first[1:], len(rows)]):
            seqs, texts = cut(rows.slice(a, b - a))
            if seqs:
                name = rows.column(0)[a].as_py()
                columns = [pa.array([name] * len(seqs), rows.schema.field(0).type), pa.array(seqs, rows.schema.field("seq").type), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return each


def _joined(rows: pa.Table) -> tuple[str, np.ndarray]:
    """The text of rows put together, and where each row ends in it."""
    texts = rows.column("text").to_pylist()
    return "".join(texts), np.cumsum([len(t) for t in texts])


#: Least number of tasks that slices are dealt to; a task holds the text of its slices.
_SLICE_PARTS = 96
_FRAME = re.compile(r"%([^$]*)\$")
#: A value that is not there, in state.
_NONE = -(1 << 62)


def effective_stream(ticks: DataFrame, commands: DataFrame, late: str = "10 minutes", key: str = "device") -> DataFrame:
    """The set-point in force at each tick or reading of a stream: (key, ts, set_point, mode).

    Commands (key, ts, seq, set_pos, manual) and ticks (key, ts) are two inputs with one state per device: what is in force,
    and the rows of both that the watermark has not reached. They are taken in order of time; a command of the same instant
    as a tick counts. Equal to ``effective_setpoint`` once the sources have ended.
    """
    kind = commands.schema[key].dataType
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(_NONE)).alias(c)
    both = commands.select(key, "ts", F.col("seq").cast("bigint").alias("seq"), number("set_pos"), number("manual"), F.lit(0).cast("bigint").alias("tick"))
    at_ticks = ticks.select(key, "ts", F.lit(1 << 62).alias("seq"), *[F.lit(_NONE).alias(c) for c in ("set_pos", "manual")], F.lit(1).cast("bigint").alias("tick"))
    rows = both.unionByName(at_ticks).withWatermark("ts", late).withColumn("at", micros(F.col("ts")))
    names = ["at", "seq", "set_pos", "manual", "tick"]

    def advance(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        force = dict(zip(("set_pos", "manual"), state.get[:2])) if state.exists else {"set_pos": _NONE, "manual": _NONE}
        held = state.get[2:] if state.exists else [[] for _ in names]
        new = [] if state.hasTimedOut else [p[names].to_numpy(dtype=np.int64) for p in parts]
        own = np.concatenate([np.array(held, np.int64).reshape(len(names), -1).T, *new])
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        upto = state.getCurrentWatermarkMs() * 1000
        done = own[own[:, 0] <= upto]
        known = {}
        for c in ("set_pos", "manual"):
            values = np.concatenate([[force[c]], done[:, names.index(c)]])
            last = np.maximum.accumulate(np.where(values != _NONE, np.arange(len(values)), 0))
            known[c] = values[last][1:]
            force[c] = int(values[last[-1]])
        waiting = own[len(done) :]
        state.update((force["set_pos"], force["manual"], *[waiting[:, k].tolist() for k in range(len(names))]))
        if len(waiting):
            state.setTimeoutTimestamp(max(-(-int(waiting[0, 0]) // 1000) - 1, upto // 1000 + 1))
        at = done[:, 4] == 1
        if at.any():
            manual, remote = known["manual"][at], known["set_pos"][at]
            by_hand = (manual != _NONE) & (manual < AUTO_MODE)
            yield pd.DataFrame(
                {
                    key: [name[0]] * int(at.sum()),
                    "ts": pd.to_datetime(done[at, 0], unit="us", utc=True),
                    "set_point": np.where(by_hand, manual, np.where(remote == _NONE, DEFAULT_SET_POINT, remote)),
                    "mode": np.where(by_hand, "MAN", "AUTO"),
                }
            )

    schema = T.StructType([T.StructField(key, kind), T.StructField("ts", T.TimestampType()), T.StructField("set_point", T.IntegerType()), T.StructField("mode", T.StringType())])
    kept = "set_pos bigint, manual bigint, " + ", ".join(f"held_{n} array<bigint>" for n in names)
    ship(commands.sparkSession)
    made = rows.groupBy(key).applyInPandasWithState(advance, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.where(F.col(key).isNotNull())


def setpoint_stream(commands: DataFrame) -> DataFrame:
    """The set-point in force per device, kept up to date; one row per changed device and trigger."""
    at = order_key(micros(F.col("ts")), F.col("seq"))
    latest = commands.groupBy("device").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("set_pos", "manual")],
        F.max("ts").alias("ts"),
    )
    return latest.select(
        "device", "ts", set_point_in_force(F.col("manual"), F.col("set_pos")).alias("set_point")
    )


def run_changes(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Store the changed rows of each trigger under its number; a repeated trigger replaces its own folder."""

    def store(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_state(spark: SparkSession, stream: DataFrame, output: str, key: str) -> DataFrame:
    """The newest stored row of each key."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    stored = spark.read.schema(schema).parquet(output)
    others = [c for c in stream.columns if c != key]
    return stored.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in others])


def combine_sessions_early(spark: SparkSession) -> None:
    """Merge sessions inside each task before the shuffle, so that a busy sensor sends few rows to its task."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
