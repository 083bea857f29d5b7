"""Words, shingles and windows of whole texts as 64-bit hashes, computed for many texts at once with NumPy.

A word is ``[^\\x20\\x09-\\x0D]+``. The hash of a word is a polynomial in its bytes, taken from prefix sums: one pass over
the bytes serves all words of a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
#: Bytes of text hashed together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    usual = BLOCK_BYTES + 4096
    have = _powers.get(base)
    if have is None or n > usual:
        factors = np.full(max(n, usual), base, dtype=np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if n <= usual:  # those of a longer text are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Words of the texts ``first .. first + len(bounds) - 2`` of a batch; text i has the words bounds[i]:bounds[i+1]."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def blocks(texts: list[str | None], lower: bool) -> Iterator[Block]:
    """Blocks of texts in order; a null text has no words. ``lower`` folds A-Z first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK_BYTES:
            yield _block(first, held, lower)
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield _block(first, held, lower)


def _block(first: int, raw: list[bytes], lower: bool) -> Block:
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    inside = np.concatenate(([False], ~gap))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _PLACE[0])
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return Block(first, data, starts, ends, hashes, np.searchsorted(starts, begins))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` hashes (order matters); empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _PLACE[1 + k]
    return mix(total)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: runs of ``width`` words, or the whole sequence if the text has fewer."""
    for block in blocks(texts, lower=True):
        runs = windows(block.hashes, width)
        for a, b in zip(block.bounds[:-1], block.bounds[1:]):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                whole = windows(block.hashes[a:b], b - a) + _PLACE[40 + b - a]
                yield mix(whole)
            else:
                yield np.zeros(0, dtype=np.uint64)
