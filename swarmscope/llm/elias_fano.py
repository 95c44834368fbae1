"""Elias-Fano sequences over byte buffers, with select by sampled positions and 64-bit windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ONE = np.uint64(1)


def windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset on, as numbers; ``data`` ends in 8 spare bytes."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)) if len(data) > 7 else np.zeros(0, np.uint64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, back to back, and 8 spare bytes."""
    out = np.zeros(-(-len(values) * width // 8) + 8, np.uint8)
    step = 1 << 16  # a multiple of 8, so that each step starts at a byte
    for i in range(0, len(values) if width else 0, step):
        bits = (values[i : i + step, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
        part = np.packbits(bits.ravel(), bitorder="little")
        out[i * width // 8 : i * width // 8 + len(part)] = part
    return out


def unpack_bits(data: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """Values number ``i``; at most 57 bits wide."""
    if not width:
        return np.zeros(len(i), np.uint64)
    bit = i * width
    return (windows(data)[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def small(values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those of 255 and more apart."""
    big = np.flatnonzero(values >= 255)
    return {"bytes": np.minimum(values, 255).astype(np.uint8), "at": big.astype(np.int64), "big": values[big].astype(np.int64)}


def unsmall(stored: dict, name: str) -> np.ndarray:
    out = stored[f"{name}.bytes"].astype(np.int64)
    out[stored[f"{name}.at"]] = stored[f"{name}.big"]
    return out


@dataclass
class EliasFano:
    n: int
    universe: int
    width: int
    sample: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray  # bit positions of every ``sample``-th one

    @classmethod
    def of(cls, values: np.ndarray, sample: int = 512) -> EliasFano:
        """Of non-decreasing values of at least 0."""
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        width = min(57, max(0, (universe // n).bit_length() - 1)) if n else 0
        low = pack_bits(values & np.uint64((1 << width) - 1), width)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)])
        kind = "<u4" if len(bits) < 1 << 32 else "<u8"
        return cls(n, universe, width, sample, low, high, ones[::sample].astype(kind))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The bit positions of the ones number ``i``."""
        view = windows(self.high)
        start = self.samples[i // self.sample].astype(np.int64)
        left = (i % self.sample).astype(np.uint64)
        byte = start >> 3
        word = view[byte] >> (start & 7).astype(np.uint64) << (start & 7).astype(np.uint64)
        on = np.arange(len(i))
        while len(on):
            has = np.bitwise_count(word[on]).astype(np.uint64)
            further = left[on] >= has
            on, has = on[further], has[further]
            left[on] -= has
            byte[on] += 8
            word[on] = view[np.minimum(byte[on], len(view) - 1)]
        at = byte << 3
        for step in (32, 16, 8, 4, 2, 1):
            has = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.uint64)
            up = left >= has
            left = np.where(up, left - has, left)
            word = np.where(up, word >> np.uint64(step), word)
            at = np.where(up, at + step, at)
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.width)) | unpack_bits(self.low, self.width, i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | unpack_bits(self.low, self.width, np.arange(self.n))

    def header(self) -> list[int]:
        return [self.n, self.universe, self.width, self.sample, len(self.low), len(self.high), len(self.samples), self.samples.itemsize]
