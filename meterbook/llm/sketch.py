"""Bloom filters that many tasks fill and the driver collects within a fixed size.

A filter has a power of two of bits, chosen from the number of entries and never above
``max_bits``. Above that size more entries pass than need to; none is ever missed, so every
user of a filter follows it with an exact step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: 64 MiB; the driver, and every Python worker, hold this much at most.
MAX_BITS = 1 << 29
_BLOCK = 1 << 16  # bytes of a filter that are merged as one row


def bits_for(entries: int, per_entry: int = 16, max_bits: int = MAX_BITS) -> int:
    want = max(1 << 16, per_entry * max(entries, 1))
    return min(max_bits, 1 << (want - 1).bit_length())


def positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """``probes`` bit positions per 64-bit hash, one row each (double hashing)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    base = hashes * np.uint64(0x9E3779B97F4A7C15)
    base ^= base >> np.uint64(29)
    return np.stack([(base + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(probes)])


def as_hashes(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


class Bits:
    """A plain array of bits."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def test(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def set(self, at: np.ndarray) -> None:
        np.bitwise_or.at(
            self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        )


def contains(data: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    """Whether all bits of each hash are set."""
    bits = Bits(len(data) * 8, data)
    found = np.ones(len(hashes), bool)
    for at in positions(hashes, bits.bits, probes):
        found &= bits.test(at)
    return found


def build(hashes: DataFrame, bits: int, probes: int, repeated: bool = False) -> np.ndarray:
    """The filter of a one-column table of bigint hashes, as bytes.

    With ``repeated`` a bit is set only where two or more entries meet: each task keeps two
    planes (met once, met again), and merging carries from the first into the second.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = Bits(bits), Bits(bits if repeated else 8)
        for batch in batches:
            at = positions(as_hashes(batch.iloc[:, 0]), bits, probes).ravel()
            if repeated:
                at, n = np.unique(at, return_counts=True)
                again.set(at[(n > 1) | once.test(at)])
            once.set(at)
        for k in range(0, len(once.data), _BLOCK):
            a = once.data[k : k + _BLOCK]
            if a.any():
                b = again.data[k : k + _BLOCK] if repeated else a[:0]
                yield pd.DataFrame(
                    {
                        "block": [k // _BLOCK],
                        "once": [zlib.compress(a.tobytes(), 1)],
                        "again": [zlib.compress(b.tobytes(), 1)],
                    }
                )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, once, again = None, None, None
        for batch in batches:
            for k, a, b in zip(batch.block, batch.once, batch.again):
                a = np.frombuffer(zlib.decompress(a), np.uint8)
                b = np.frombuffer(zlib.decompress(b), np.uint8)
                if k == block:
                    if repeated:
                        again = again | b | (once & a)
                    once = once | a
                    continue
                if block is not None:
                    yield _row(block, again if repeated else once)
                block, once, again = k, a, b
        if block is not None:
            yield _row(block, again if repeated else once)

    parts = hashes.mapInPandas(fill, "block int, once binary, again binary")
    merged = parts.repartition("block").sortWithinPartitions("block")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.mapInPandas(merge, "block int, data binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(row.data)), np.uint8)
        out[row.block * _BLOCK : row.block * _BLOCK + len(part)] = part
    return out


def _row(block: int, data: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": [block], "data": [zlib.compress(data.tobytes(), 1)]})
