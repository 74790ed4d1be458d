"""Vectorised work on the UTF-8 bytes of a batch of texts (inside Spark tasks).

A batch's texts lie one after the other in one byte array; `offsets` holds where each
begins and ends. All functions work on whole chunks at once, so the cost per byte is a few
numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 8192, dtype=np.uint64) | np.uint64(1)
_PERIOD = 4096
_GRAM = _RANDOM[_PERIOD:]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all of them."""
    x = x ^ (x >> _MIX[2])
    x *= _MIX[0]
    x ^= x >> _MIX[2]
    x *= _MIX[1]
    x ^= x >> _MIX[2]
    return x


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of chunks of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words, and for each text the index of its first word (and the end)."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    before[at] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=before[1:])
    step = np.repeat(starts - before[:-1], lengths)
    at = np.arange(before[-1])
    value = data[at + step].astype(np.uint64)
    value += np.uint64(1)
    at -= np.repeat(before[:-1], lengths)
    if lengths.max() > _PERIOD:
        # Beyond a period places have multipliers of their own, so that equal bytes a period apart don't trade places unseen.
        far = np.flatnonzero(at >= _PERIOD)
        value[far] *= mix64(at[far].astype(np.uint64)) | np.uint64(1)
    at &= _PERIOD - 1
    value *= _RANDOM[at]
    return mix64(np.add.reduceat(value, before[:-1]) + lengths.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes, over the whole chunk (runs may cross texts)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += hashes[i : i + m] * _GRAM[i % len(_GRAM)]
    return mix64(total + np.uint64(n))


def runs_inside(first: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which runs of n words lie within one text, by their first word."""
    m = n_words - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    owner = np.searchsorted(first, np.arange(m), side="right") - 1
    return np.arange(m) + n <= first[owner + 1]
