"""Best-fit packing of token sequences with a bounded number of open bins.

Documents become ids of a byte-level BPE vocabulary, each closed by an end id. Only a document longer than a sequence is
cut; its first piece takes what is over, so all others fill a sequence. The rest is packed online: a piece goes into the
open bin with the least free space that holds it; there are at most ``open_bins``, and when one more is needed the
fullest closes. Free spaces with an open bin are the bits of one integer, so the best bin is the lowest bit at or above the
piece's length.

Pieces are dealt by hash to packers of about ``packer_tokens`` tokens each, which run side by side. A packer takes its pieces as
they come, in the order of their hashes, and bins close all the time: ``open_bins`` is an eighth of the sequences it fills.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import wordhash
from hearthline.llm.common import map_arrow, stored
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    length: int = 2048
    end_id: int = 0
    open_bins: int = 256
    packer_tokens: int = 1 << 22
    vocabulary: str = "byte_bpe_50k.json"


# ---------------------------------------------------------------- tokens

_LETTER, _NUMBER, _BLANK, _OTHER, _EDGE = range(5)
_EDGE_POINT = 0x110000
#: White space of the vocabulary's pattern. Fixed values.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces whose ids a worker remembers; when there are more, the half that was met most often stays.
REMEMBERED = 500_000
#: Words that are encoded as one text.
JOINED = 500
SLOT_BITS = 20
#: Code points tokenized at once; a longer text is a block of its own.
BLOCK_POINTS = 1 << 18


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and a random number for each."""
    kinds = np.full(_EDGE_POINT + 1, _OTHER, dtype=np.uint8)
    for i in range(_EDGE_POINT):
        first = unicodedata.category(chr(i))[0]
        if first == "L":
            kinds[i] = _LETTER
        elif first == "N":
            kinds[i] = _NUMBER
    kinds[_BLANKS] = _BLANK
    kinds[_EDGE_POINT] = _EDGE
    return kinds, wordhash.mix(np.arange(1, _EDGE_POINT + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cut_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the pieces into which the vocabulary's pattern cuts texts, and places where one may end.

    ``points``: code points of texts, each text followed by an edge, and two edges at the end. A piece is a run of letters, of
    numbers or of other signs, each with a plain space before it if there is one, an English ending after an
    apostrophe, or white space, whose last character before a word stands alone unless it is that space.
    """
    kinds = _kinds()[0][points]
    before = np.concatenate(([_EDGE], kinds[:-1]))
    first = (kinds != before) & (kinds != _EDGE)
    after_blank = np.flatnonzero((before == _BLANK) & (kinds != _BLANK) & (kinds != _EDGE))
    first[after_blank - 1] = True
    first[after_blank] = points[after_blank - 1] != 32
    mark = np.flatnonzero((points == 39) & first)
    one, two = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for chosen, width in ((mark[short], 2), (mark[long & ~short], 3)):
        first[chosen + 1] = False
        first[chosen + width] = kinds[chosen + width] != _EDGE
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(first | (kinds == _EDGE))


class Tokenizer:
    """Ids of whole texts. Pieces that were met before come from a table; new ones are encoded by the vocabulary."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Vocabulary

        self._vocabulary = Vocabulary.from_file(vocabulary)
        self._vocabulary.encode_special_tokens = True  # ``ids`` has taken them out before
        added = self._vocabulary.get_added_tokens_decoder()
        self._added = {t.content: i for i, t in added.items()}
        # at one place the longest one counts
        either = "|".join(re.escape(c) for c in sorted(self._added, key=len, reverse=True))
        self._marks = re.compile(f"({either})") if either else None
        #: Tokens that take in blanks or look at their neighbours are left to the vocabulary.
        plain = self._vocabulary.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self._whole = None if plain else Vocabulary.from_file(vocabulary)
        #: Bytes of each token: the vocabulary writes a byte as a character.
        names = self._vocabulary.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self._bytes[i] = len(name)
        self._keys, self._at = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self._known = self._filled = 0
        self._hash = np.zeros(1 << 10, dtype=np.uint64)
        self._begin, self._count, self._pool, self._met = (np.zeros(1 << 10, dtype=np.int64) for _ in range(4))

    def _forget(self) -> None:
        """Keep the half of the pieces that was met most often, in half as many times as counted."""
        kept = np.sort(np.argsort(-self._met[: self._known], kind="stable")[: self._known // 2])
        hashes, counts, met = self._hash[kept], self._count[kept], self._met[kept] // 2
        upto = np.cumsum(counts)
        ids = self._pool[np.repeat(self._begin[kept] - upto + counts, counts) + np.arange(upto[-1])]
        self._known = self._filled = 0
        self._keys[:] = 0
        self._add(hashes, counts, ids)
        self._met[: len(met)] = met

    def _insert(self, rows: np.ndarray) -> None:
        """Put rows into the table of slots: in each round one row takes each free slot, the others step on."""
        slots = (self._hash[rows] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(rows):
            place, first = np.unique(slots, return_index=True)
            first = first[self._keys[place] == 0]
            self._keys[slots[first]], self._at[slots[first]] = self._hash[rows[first]], rows[first]
            left = np.ones(len(rows), bool)
            left[first] = False
            rows, slots = rows[left], (slots[left] + 1) & ((1 << SLOT_BITS) - 1)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids as the vocabulary gives them without added special tokens: its added tokens in a text have their own ids."""
        parts = [self._marks.split(t) if self._marks else [t] for t in texts]  # odd ones are added tokens
        between = self.encode([x for own in parts if len(own) == 1 or self._whole is None for x in own[::2]])
        for text, own in zip(texts, parts):
            if len(own) == 1:
                yield next(between)
            elif self._whole is not None:
                yield np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                yield np.concatenate([np.array([self._added[x]], dtype="<u4") if k % 2 else next(between) for k, x in enumerate(own)])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of ordinary text, in which the strings of special tokens mean nothing."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > BLOCK_POINTS:
                yield from self._block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._block(held)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        edge = np.array([_EDGE_POINT], dtype=np.uint32)
        parts: list[np.ndarray] = []
        for text in texts:
            try:
                own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            except UnicodeEncodeError:  # lone surrogates cannot be written as UTF-8 and are read as the replacement character
                own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                own = np.where((own >= 0xD800) & (own < 0xE000), np.uint32(0xFFFD), own)
            parts += [own, edge]
        points = np.concatenate([*parts, edge, edge])
        starts, stops = cut_points(points)
        if not len(starts):
            for _ in texts:
                yield np.zeros(0, dtype="<u4")
            return
        ends = stops[np.searchsorted(stops, starts, side="right")]
        values = _kinds()[1][points]
        n = len(points)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * wordhash._power(wordhash._BASE, n), out=sums[1:])
        hashes = wordhash.mix((sums[ends] - sums[starts]) * wordhash._power(wordhash._INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
        rows = self._find(hashes)
        if (rows < 0).any():
            if self._known > REMEMBERED:
                self._forget()
                rows = self._find(hashes)
            unknown = np.flatnonzero(rows < 0)
            unique, example = np.unique(hashes[unknown], return_index=True)
            at = unknown[example]
            self._learn(unique, points, starts[at], ends[at])
            rows = self._find(hashes)
        self._met[: self._known] += np.bincount(rows, minlength=self._known)
        counts = self._count[rows]
        upto = np.cumsum(counts)
        ids = self._pool[np.repeat(self._begin[rows] - upto + counts, counts) + np.arange(upto[-1])].astype("<u4")
        edges = np.flatnonzero(points[:-2] == _EDGE_POINT)
        bounds = np.concatenate(([0], upto))[np.concatenate(([0], np.searchsorted(starts, edges)))]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of pieces, -1 where unknown: all of them step through the table of slots together."""
        rows = np.full(len(hashes), -1, dtype=np.int64)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self._keys[slots]
            same = keys == hashes[left]
            rows[left[same]] = self._at[slots[same]]
            go = ~same & (keys != 0)
            left, slots = left[go], (slots[go] + 1) & ((1 << SLOT_BITS) - 1)
        return rows

    def _learn(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new pieces. Words with a space before them are encoded many at a time, as a text is cut there anyway."""
        outside = np.concatenate([[0], np.cumsum(_kinds()[0][points] != _LETTER)])
        words = (points[starts] == 32) & (ends - starts > 1) & (outside[ends] == outside[starts + 1])
        if words.any():
            self._learn_joined(hashes[words], points, starts[words], ends[words])
        rest = np.flatnonzero(~words)
        if len(rest):
            texts = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
            self._add(hashes[rest], *self._each(texts))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [x.ids for x in self._vocabulary.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(m) for m in made], dtype=np.int64), np.array([x for m in made for x in m], dtype=np.int64)

    def _learn_joined(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes = ends - starts
        upto = np.cumsum(sizes)
        own = points[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], upto[JOINED - 1 : -1 : JOINED], [upto[-1]]])
        texts = [own[a:b].tobytes().decode("utf-32-le") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
        _, ids = self._each(texts)
        # a token belongs to the word in whose bytes it ends
        width = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
        stops = np.cumsum(width)[upto - 1]
        reached = np.cumsum(self._bytes[ids])
        word = np.searchsorted(stops, reached)
        counts = np.bincount(word, minlength=len(stops))
        last = np.cumsum(counts) - 1
        if len(counts) != len(stops) or not (counts > 0).all() or (reached[last] != stops).any():  # a vocabulary that lacks bytes
            counts, ids = self._each([own[b - n : b].tobytes().decode("utf-32-le") for b, n in zip(upto.tolist(), sizes.tolist())])
        self._add(hashes, counts, ids)

    def _add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Write behind what is known; arrays are made twice as long when they are full."""
        known, filled = self._known, self._filled
        upto, end = known + len(hashes), filled + len(ids)
        if upto > len(self._hash):
            self._hash, self._begin, self._count, self._met = (np.resize(x, 2 * upto) for x in (self._hash, self._begin, self._count, self._met))
        if end > len(self._pool):
            self._pool = np.resize(self._pool, 2 * end)
        self._hash[known:upto], self._count[known:upto], self._met[known:upto] = hashes, counts, 0
        self._begin[known:upto] = filled + np.cumsum(counts) - counts
        self._pool[filled:end] = ids
        self._known, self._filled = upto, end
        self._insert(np.arange(known, upto))


@lru_cache(1)
def tokenizer(name: str) -> Tokenizer:
    """One per worker. ``name``: a file of the public vocabularies, or a path."""
    if "/" not in name:
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    return Tokenizer(name)


def cut_lengths(total: int, length: int) -> list[int]:
    """Lengths of the pieces of a document: only the first may be shorter than a sequence."""
    rest = total % length
    return ([rest] if rest or not total else []) + [length] * (total // length)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(documents: DataFrame, settings: Settings = Settings(), ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every document, with their ids if asked for. A null text is an empty one: the end id alone."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        out: list[tuple] = []
        for owner, own in zip(rows.column(0).to_pylist(), tokenizer(settings.vocabulary).ids(texts)):
            whole = np.append(own, np.array([settings.end_id], dtype="<u4"))
            begin = 0
            for k, n in enumerate(cut_lengths(len(whole), settings.length)):
                part = whole[begin : begin + n]
                out.append((owner, k, begin, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if ids else None))
                begin += n
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            columns.append(pa.array([x[5] for x in out], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    chosen = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(chosen, batch, PIECES + (", ids array<int>" if ids else ""))


# ---------------------------------------------------------------- bins


class BestFit:
    """Online best fit with at most ``open_bins`` open bins; bins are numbered as they are opened."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.limit = length, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[int]] = {}
        self.open = self.opened = self.closed = 0

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``size``."""
        above = self.free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            name = self._leave(space)
        else:
            if self.open >= self.limit:
                # the fullest closes
                self._leave((self.free & -self.free).bit_length() - 1)
                self.open -= 1
                self.closed += 1
            space, name = self.length, self.opened
            self.opened += 1
            self.open += 1
        if space > size:
            self.bins.setdefault(space - size, []).append(name)
            self.free |= 1 << (space - size)
        else:
            self.open -= 1
        return name, self.length - space

    def _leave(self, space: int) -> int:
        names = self.bins[space]
        name = names.pop()
        if not names:
            del self.bins[space]
            self.free ^= 1 << space
        return name


def _pack(part: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    part = part.sort_values(["turn", "doc_id", "piece"], kind="stable")
    fit = BestFit(settings.length, settings.open_bins)
    placed = [fit.add(n) for n in part["length"].tolist()]
    return part.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed])


def pack(cut: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces (columns as in ``PIECES``, more may follow).

    A piece that fills a sequence is one by itself. Offsets are gapless from 0 in each sequence. Equal input gives equal
    places up to the exchange of fully equal rows. No rows give no rows.
    """
    ship(cut.sparkSession)
    held = stored(cut.withColumn("turn", F.xxhash64("doc_id", "piece", "start", "ids_crc32")), "pieces")
    short = held.where(F.col("length") < settings.length)
    total = short.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // settings.packer_tokens))
    schema = short.limit(0).selectExpr("*", "0 AS packer", "0L AS bin", "0L AS offset").schema
    dealt = short.withColumn("packer", F.pmod(F.xxhash64("turn"), F.lit(packers)).cast("int"))
    packed = dealt.groupBy("packer").applyInPandas(lambda p: _pack(p, settings), schema)
    columns = [*cut.columns, "sequence_id", "offset"]
    # even numbers: packed sequences; odd ones: pieces that fill a sequence
    number = F.col("packer").cast("bigint") * (1 << 32) + F.col("bin") * 2
    full = held.where(F.col("length") >= settings.length)
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.withColumn("sequence_id", number).select(columns).unionByName(alone.select(columns))
