"""Words of many texts at once, as arrays: where they stand and a 64-bit hash of each."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 19
_powers = {k: np.ones(1, dtype=np.uint64) for k in (_STEP, _BACK)}

# bytes of words: all but ASCII white space; letters and digits, with every byte beyond ASCII counted among the letters
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 modulo 2**64; kept up to the chunk, so that memory stays small."""
    kept = _powers[base]
    if len(kept) < n:
        kept = np.full(max(n, _CHUNK + 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept)
        if n <= _CHUNK + 1:
            _powers[base] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words of texts that lie one after the other in ``data``."""
    word = inside[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # words end with their text
    starts[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, a polynomial of its bytes that is then mixed with its length."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + _CHUNK, side="right")))
        part = data[first:ends[j - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _power(_STEP, len(part)), out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((total[b] - total[a]) * _power(_BACK, len(part))[a] + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        i = j
    return out


def groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with at most ``limit`` in all, or one row of more."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, and where each begins (with the end at last)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets
