"""Periodic runs of words: stretches that repeat a period of words at least three times.

A word of a run with period q and a length of at least ``least_times`` periods occurs at least ``least_times`` times in it. So a
word that occurs more rarely within a segment belongs to no run of the segment, and splits it. The parts are counted anew, until
no word of a segment is too rare. What survives is scanned lag by lag: at lag q every q-th word is compared with the one q words
on, which meets each run of that period, and a hit is extended word by word to both sides. Texts are seen one by one, so nothing
is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import map_arrow


@dataclass(frozen=True)
class Settings:
    """A run has at least ``least_words`` words and ``least_times`` periods (24 or more, and 3 or more)."""

    least_words: int = 24
    least_times: int = 3

    def __post_init__(self) -> None:
        if self.least_words < 24 or self.least_times < 3:
            raise ValueError("probes of eight words find runs of at least 24 words and three periods")


#: Words of a probe. Where a run has 24 words and three periods, one probe at a multiple of the period lies with its copy inside.
PROBE = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def segments(ids: np.ndarray, settings: Settings = Settings()) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs often enough, split level by level until none changes."""
    found: list[tuple[int, int]] = []
    if len(ids) < settings.least_words:
        return found
    at = np.flatnonzero(np.bincount(ids)[ids] >= settings.least_times)
    if len(at) == len(ids):
        return [(0, len(ids))]
    label = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
    width = int(ids.max()) + 1
    while len(at):
        long_enough = (np.bincount(label) >= settings.least_words)[label]
        at, label = at[long_enough], label[long_enough]
        if not len(at):
            break
        _, place, times = np.unique(label * width + ids[at], return_inverse=True, return_counts=True)
        rare = times[place] < settings.least_times
        split = np.zeros(int(label[-1]) + 1, bool)
        split[label[rare]] = True
        stable = ~split[label]
        kept = at[stable]
        if len(kept):
            starts = np.flatnonzero(np.diff(label[stable], prepend=-1) != 0)
            ends = np.append(starts[1:], len(kept)) - 1
            found += zip(kept[starts].tolist(), (kept[ends] + 1).tolist())
        left = split[label] & ~rare
        at, label = at[left], label[left]
        if len(at):
            label = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(label, prepend=-1) != 0)) - 1
    return sorted(found)


def _probes(ids: np.ndarray) -> np.ndarray:
    """A number for each stretch of ``PROBE`` words; equal stretches have equal ones."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - PROBE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(PROBE):
        out = out * _FACTOR + mixed[k : k + n]
    return out


def _first(equal: Callable[[int, int], np.ndarray], n: int) -> int:
    """Number of leading true values of ``equal(from, to)`` up to ``n``, looked up in growing steps."""
    done, step = 0, 64
    while done < n:
        part = equal(done, min(n, done + step))
        stop = int(np.argmin(part))
        if not part[stop]:
            return done + stop
        done, step = done + len(part), step * 2
    return n


def _repeated(probes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` places whose probes all occur twice or more: a run is inside one."""
    _, place, times = np.unique(probes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[place] > 1)
    if not len(at):
        return []
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    ends = np.append(starts[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + 1) for a, b in zip(starts, ends) if b - a + 1 >= least]


def find_runs(ids: np.ndarray, settings: Settings = Settings()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of word numbers, by start and period."""
    runs: list[tuple[int, int, int]] = []
    whole = None
    for start, end in segments(ids, settings):
        whole = _probes(ids) if whole is None else whole
        for a, b in _repeated(whole[start : end - PROBE + 1], settings.least_words - PROBE + 1):
            runs += _scan(ids, whole, start + a, start + b, settings)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _scan(ids: np.ndarray, probes: np.ndarray, start: int, end: int, settings: Settings) -> list[tuple[int, int, int]]:
    """Runs whose probes start in [start, end), by rising lag: a stretch that was found has a smaller period."""
    own = probes[start:end]
    found: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int, int]] = []  # (start, end, period)
    for lag in range(1, (end - start + PROBE - 1) // settings.least_times + 1):
        grid = own[::lag]
        hits = np.flatnonzero(grid[1:] == grid[:-1])
        k = 0
        while k < len(hits):
            at = start + int(hits[k]) * lag
            known = _inside(order, at, lag)
            if known is not None:
                k = int(np.searchsorted(hits, -(-(known - lag - start + 1) // lag), side="left")) if known - lag > at else k + 1
                continue
            ahead = _first(lambda i, j: ids[at + i : at + j] == ids[at + lag + i : at + lag + j], len(ids) - lag - at)
            if ahead:
                behind = _first(lambda i, j: (ids[at - j : at - i] == ids[at + lag - j : at + lag - i])[::-1], at)
                run = (at - behind, behind + ahead + lag)
                if run[1] >= max(settings.least_words, settings.least_times * lag) and run not in found:
                    found[run] = lag
                    bisect.insort(order, (run[0], run[0] + run[1], lag))
            k = max(k + 1, int(np.searchsorted(hits, (at + ahead - start) // lag, side="left")))
    return [(s, n, q) for (s, n), q in found.items()]


def _inside(order: list[tuple[int, int, int]], at: int, lag: int) -> int | None:
    """End of a known run whose period divides the lag and that holds a word and its copy: nothing new there.

    Only the runs that start nearest are looked at: a run that is missed is found a second time and is not counted again.
    """
    k = bisect.bisect_right(order, (at, 1 << 62, 0))
    for s, e, q in order[max(0, k - 4) : k]:
        if lag % q == 0 and at + lag + PROBE <= e:
            return e - PROBE
    return None


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: each run keeps its first period, unless another run drops from it."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def periodic_runs(
    documents: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per document: id, ``n_words``, ``runs`` (start, length, period; by start and period), ``best`` and ``collapsed``.

    ``best`` is the run with the most periods (ties: smallest start, then period; null without a run) and ``collapsed`` the text
    without repetition, its words joined by one space. Words are what ASCII white space divides. ``rewrite(id, words)`` may replace
    the words of a text before. A null or empty text has no words and no runs. Rows stay as they are: repeated ids and null ids
    give a row each, no row gives none. Other columns are not read.
    """
    kind = documents.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(_RUN)),
            T.StructField("best", _RUN),
            T.StructField("collapsed", T.BinaryType()),
        ]
    )
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes, runs, best, texts = [], [], [], []
        for identifier, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            words = (text or b"").split()
            if rewrite is not None:
                words = rewrite(identifier, words)
            own = find_runs(number(words), settings) if len(words) >= settings.least_words else []
            sizes.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
            top = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            best.append(None if top is None else dict(zip(("start", "length", "period"), top)))
            texts.append(b" ".join(collapse(words, own)))
        columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    texts = documents.select(F.col(id_column), F.col(text_column).cast("string").cast("binary").alias("text"))
    return map_arrow(texts, batch, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def number(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
