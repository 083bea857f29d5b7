"""Quality rules: compression bands.

zstandard compresses a whole document and its fixed chunks on their own. A document whose ratio (bytes before / after)
leaves the band of its length is rejected: above it the text repeats itself, below it it is noise. The lower limits come
from the corpus itself: quartiles of the ratio in each length class, over all documents. Chunks catch a repetitive or
random stretch inside an otherwise ordinary long document. Base counts of words, symbols, repeated lines and repeated word
windows come along, with two plain limits on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import wordhash
from hearthline.llm.common import map_arrow, stored

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits by UTF-8 length: (from bytes, least ratio, greatest ratio), in rising order.

    Short texts hardly compress, and ratios of ordinary prose rise with length. ``chunk`` bytes are compressed at a time
    (the last chunk of a longer text is its last ``chunk`` bytes); with more than ``bad_share`` of the chunks outside
    ``chunk_band``, or ``bad_run`` of them in a row, the document is rejected.

    The least ratios hold where the corpus tells nothing. Elsewhere the limit is the lower quartile less ``fence`` times the
    distance of the quartiles (``chunk_fence`` for chunks), taken from classes of ``least_texts`` different texts or more.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 8.0),
        (256, 1.10, 3.0),
        (512, 1.20, 3.2),
        (1024, 1.30, 3.4),
        (4096, 1.40, 3.6),
        (16384, 1.45, 4.2),
        (65536, 1.50, 5.0),
    )
    chunk: int = 4096
    chunk_band: tuple[float, float] = (1.25, 6.0)
    bad_share: float = 0.1
    bad_run: int = 2
    fence: float = 2.5
    chunk_fence: float = 4.0
    least_texts: int = 30
    level: int = 3
    min_words: int = 20
    max_repeat_percent: int = 30


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_bytes bigint, ratio double, chunk_ratios array<double>, text_key bigint"
)
#: First lengths of the length classes, four to each doubling.
CLASSES = np.unique(np.ceil(2.0 ** (np.arange(4 * 40) / 4)).astype(np.int64))
#: Ratios are counted in steps of 1 / STEPS.
STEPS = 200


def measure(documents: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and ratios of each whole text, one row per row of ``documents``.

    A null text counts as an empty one: all counts 0, ratio 0. Repeated rows give repeated results. One narrow pass.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).to_pylist()
        out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("words", "chars", "symbols", "lines", "repeats")}
        for block in wordhash.blocks(texts, lower=False):
            _counts(block, out)
        ratios = [_ratios(t, bands) for t in texts]
        for i, t in enumerate(texts):
            out["lines"][i] = _repeated_lines(t)
        columns = [rows.column(0), *(pa.array(out[k]) for k in ("words", "chars", "symbols", "lines", "repeats"))]
        columns += [pa.array([r[k] for r in ratios], kind) for k, kind in enumerate(_KINDS)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names)

    chosen = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(chosen, batch, SCHEMA)


def _counts(block: wordhash.Block, out: dict[str, np.ndarray]) -> None:
    """Words, their code points and symbols, and words in repeated windows, of the texts of one block."""
    n = len(block.bounds) - 1
    rows = slice(block.first, block.first + n)
    out["words"][rows] = np.diff(block.bounds)
    # a code point starts at every byte that is not 10xxxxxx; only bytes inside words count
    lead = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(lead[block.ends] - lead[block.starts])))
    out["chars"][rows] = np.diff(chars[block.bounds])
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[block.data])))
    signs = np.concatenate(([0], np.cumsum(marks[block.ends] - marks[block.starts])))
    out["symbols"][rows] = np.diff(signs[block.bounds])
    runs = wordhash.windows(block.hashes, WINDOW)
    for i, (a, b) in enumerate(zip(block.bounds[:-1], block.bounds[1:])):
        if b - a <= WINDOW:
            continue
        own = runs[a : b - WINDOW + 1]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(len(own), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            change = np.zeros(b - a + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            out["repeats"][block.first + i] = np.count_nonzero(np.cumsum(change[:-1]))


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


_compressors: dict[int, zstandard.ZstdCompressor] = {}


_KINDS = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64())


def _ratios(text: str | None, bands: Bands) -> tuple[int, float, list[float], int]:
    """Bytes, ratio, ratios of the chunks and a key of a text. A text of one chunk or less has no chunks."""
    if not text:
        return 0, 0.0, [], 0
    raw = text.encode("utf-8", "surrogatepass")
    squeeze = _compressors.setdefault(bands.level, zstandard.ZstdCompressor(level=bands.level)).compress
    last = len(raw) - bands.chunk
    parts = [raw[i : i + bands.chunk] for i in [*range(0, last, bands.chunk), last]] if last > 0 else []
    key = int.from_bytes(xxhash.xxh3_64_digest(raw), "big", signed=True)
    return len(raw), len(raw) / len(squeeze(raw)), [len(p) / len(squeeze(p)) for p in parts], key


# ---------------------------------------------------------------- limits


@dataclass(frozen=True)
class Limits:
    """Limits in force: (from bytes, least ratio, greatest ratio) in rising order, and the band of chunks."""

    whole: tuple[tuple[int, float, float], ...]
    chunk_band: tuple[float, float]


def limits(documents: DataFrame, bands: Bands = Bands(), text_column: str = "text") -> Limits:
    """The limits that all texts of ``documents`` give. One narrow pass and a count of steps per length class."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        ratios = [_ratios(t, bands) for t in rows.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ratios], kind) for k, kind in enumerate(_KINDS)], names)

    names = ["n_bytes", "ratio", "chunk_ratios", "text_key"]
    texts = documents.select(F.col(text_column).cast("string").alias("text"))
    return _derived(map_arrow(texts, batch, "n_bytes bigint, ratio double, chunk_ratios array<double>, text_key bigint"), bands)


def _derived(measured: DataFrame, bands: Bands) -> Limits:
    """Limits from ``n_bytes``, ``ratio``, ``chunk_ratios`` and ``text_key`` of every text; copies of a text count once.

    What repeats itself is left out, as it is rejected anyway. The driver gets one row per length class and step.
    """
    once = measured.where("n_bytes > 0").select("text_key", "n_bytes", "ratio", "chunk_ratios").distinct()
    starts = F.array(*[F.lit(int(x)) for x in CLASSES])
    # chunks are class -1
    place = F.size(F.filter(starts, lambda x: x <= F.col("n_bytes"))) - 1
    whole = F.struct(place.alias("at"), F.col("ratio"), _greatest(bands).alias("most"))
    chunks = F.transform("chunk_ratios", lambda r: F.struct(F.lit(-1).alias("at"), r.alias("ratio"), F.lit(bands.chunk_band[1]).alias("most")))
    rows = once.select(F.explode(F.concat(F.array(whole), chunks)).alias("x")).select("x.*").where("ratio <= most")
    counted = rows.groupBy("at", F.floor(F.col("ratio") * STEPS).alias("step")).count().collect()
    steps: dict[int, list[tuple[int, int]]] = {}
    for r in counted:
        steps.setdefault(r["at"], []).append((r["step"], r["count"]))
    return _limits(steps, bands)


def _limits(steps: dict[int, list[tuple[int, int]]], bands: Bands) -> Limits:
    def fence(own: list[tuple[int, int]], times: float) -> float | None:
        at, n = (np.array(x) for x in zip(*sorted(own)))
        upto = np.cumsum(n)
        if upto[-1] < bands.least_texts:
            return None
        low, high = at[np.searchsorted(upto, np.array([0.25, 0.75]) * upto[-1])]
        return float(low - times * (high - low)) / STEPS

    found = [(int(CLASSES[k]), f) for k in sorted(steps) if k >= 0 and (f := fence(steps[k], bands.fence)) is not None]
    own = [f for _, f in found]
    # the median of five classes: one that a group of near copies fills does not decide its own limit
    smooth = [float(np.median(own[max(0, i - 2) : i + 3])) for i in range(len(own))]
    smooth[:2] = [min(a, b) for a, b in zip(smooth[:2], own)]
    # ratios rise with length, so a limit also holds for longer texts of which there are too few
    known = [(start, f) for (start, _), f in zip(found, smooth)]
    whole = []
    for start in sorted({b[0] for b in bands.whole} | {k for k, _ in known}):
        _, low, high = [b for b in bands.whole if start >= b[0]][-1]
        whole.append((start, max([low, *[f for k, f in known if k <= start][-1:]]), high))
    low, high = bands.chunk_band
    of_chunks = fence(steps[-1], bands.chunk_fence) if -1 in steps else None
    if of_chunks is not None:
        low = max(low, of_chunks)
    return Limits(tuple(whole), (low, high))


def _greatest(bands: Bands):
    most = F.lit(bands.whole[0][2])
    for start, _, high in bands.whole[1:]:
        most = F.when(F.col("n_bytes") >= start, F.lit(high)).otherwise(most)
    return most


def _bad_chunks(ratios: list[float], band: tuple[float, float], bands: Bands) -> bool:
    """Whether too many of the chunks, or too many in a row, leave the band."""
    bad = [not band[0] <= r <= band[1] for r in ratios]
    run = longest = 0
    for b in bad:
        run = run + 1 if b else 0
        longest = max(longest, run)
    return longest >= bands.bad_run or sum(bad) > bands.bad_share * len(bad)


def _band(size: int, ratio: float, chunks: list[float], found: Limits, bands: Bands) -> str:
    _, low, high = [b for b in found.whole if size >= b[0]][-1]
    if ratio < low:
        return "low"
    if ratio > high:
        return "high"
    return "chunks" if _bad_chunks(chunks, found.chunk_band, bands) else "ok"


def quality_rules(documents: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``measure`` and the verdicts ``base_failed``, ``band`` (low, high, chunks or ok) and ``kept``."""
    rows = stored(measure(documents, bands, id_column, text_column), "quality")
    found = _derived(rows, bands)
    at = rows.columns.index("n_bytes")

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        measured = zip(*(part.column(at + k).to_pylist() for k in range(3)))
        return part.append_column("band", pa.array([_band(*m, found, bands) for m in measured], pa.string()))

    failed = (F.col("n_words") < bands.min_words) | (100 * F.col("n_repeat_words") > bands.max_repeat_percent * F.col("n_words"))
    judged = map_arrow(rows, batch, SCHEMA + ", band string").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("band") == "ok"))


def keep_good(documents: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``documents`` that pass, unchanged, with all their columns. Two narrow passes without a join: the first
    one gives the limits."""
    at = documents.columns.index(text_column)
    found = limits(documents, bands, text_column)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([_passes(t, found, bands) for t in _with_counts(part.column(at).to_pylist())], pa.bool_()))

    return map_arrow(documents, batch, documents.schema)


def _with_counts(texts: list[str | None]) -> list[tuple[str | None, int, int]]:
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("words", "chars", "symbols", "lines", "repeats")}
    for block in wordhash.blocks(texts, lower=False):
        _counts(block, out)
    return list(zip(texts, out["words"].tolist(), out["repeats"].tolist()))


def _passes(measured: tuple[str | None, int, int], found: Limits, bands: Bands) -> bool:
    text, words, repeats = measured
    if words < bands.min_words or 100 * repeats > bands.max_repeat_percent * words:
        return False
    return _band(*_ratios(text, bands)[:3], found, bands) == "ok"
