"""Words and word n-grams of Arrow text batches as 64-bit hashes, computed with numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D; in UTF-8 no byte of
another character falls into that set. A word hash is a polynomial over its bytes modulo
2**64, read off a running sum, and finished with a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a document above it is cut at white space.
SLICE_BYTES = 1 << 20

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power_table(radix: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(radix))
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + 1), radix, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[int(radix)] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def _word_flags(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word; no word crosses a break."""
    inside = _word_flags(data)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    start[breaks] |= inside[breaks]
    end[breaks - 1] |= inside[breaks - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    values = data.astype(np.uint64) + np.uint64(1)
    if lower:
        values[(data >= 65) & (data <= 90)] += np.uint64(32)
    values *= _power_table(_RADIX, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    raw = (total[ends] - total[starts]) * _power_table(_RADIX_INVERSE, len(data))[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about SLICE_BYTES that end before white space."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while end < len(data):
            gap = np.flatnonzero(~_word_flags(data[end : end + SLICE_BYTES]))
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + SLICE_BYTES)
        yield data[at:end]
        at = end
    yield data[at:]


def hashed_words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word hashes, bounds)`` for slices of rows.

    The words of row ``first + i`` are ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        last = min(max(last, row + 1), rows)
        part = data[offsets[row] : offsets[last]]
        if last == row + 1 and len(part) > SLICE_BYTES:
            hashes = np.concatenate(
                [_hash(p, *_spans(p, np.zeros(0, np.int64)), lower) for p in _pieces(part)]
            )
            bounds = np.array([0, len(hashes)])
        else:
            cuts = offsets[row : last + 1] - offsets[row]
            starts, ends = _spans(part, cuts)
            hashes = _hash(part, starts, ends, lower) if len(starts) else np.zeros(0, np.uint64)
            bounds = np.searchsorted(starts, cuts)
        yield row, hashes, bounds
        row = last


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; empty below ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _GRAM + words[j : j + n]
    return mix(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a shorter text is one shingle, no words are none."""
    if 0 < len(words) < k:
        return mix(grams(words, len(words)) ^ np.uint64(len(words)))
    return np.unique(grams(words, k))
