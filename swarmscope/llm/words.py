"""Words of whole texts as 64-bit hashes, over Arrow buffers, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a polynomial in random 64-bit values of its
bytes, from running sums over the buffer, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUES[ord("A") : ord("Z") + 1] = VALUES[ord("a") : ord("z") + 1]
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
CHUNK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, STEP, np.uint64), np.full(size, BACK, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a string column, nulls as empty, per Arrow chunk."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.cast(pa.large_string()).fill_null("")
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, np.int64, len(part) + 1, part.offset * 8) if len(part) else np.zeros(1, np.int64)
        yield (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j
        i = j


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about CHUNK bytes, cut at white space; a longer word stays whole."""
    i = 0
    while i < len(data):
        j = min(len(data), i + CHUNK)
        while j < len(data):
            gap = np.flatnonzero(SPACE[data[j : j + CHUNK]])
            if len(gap):
                j += int(gap[0])
                break
            j = min(len(data), j + CHUNK)
        yield data[i:j]
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some documents, in order, and each document's offset among them."""
    first, last = int(offsets[0]), int(offsets[-1])
    data, offsets = data[first:last], offsets - first
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 2 * CHUNK:
        cut = list(pieces(data))
        if len(cut) > 1:
            words = np.concatenate([hash_words(part, np.array([0, len(part)]))[0] for part in cut])
            return words, np.array([0, len(words)])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    starts = np.flatnonzero(inside[:-1] & (cut[:-1] | np.concatenate([[True], ~inside[:-2]])))
    ends = np.flatnonzero(inside[:-1] & (cut[1:] | ~inside[1:])) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, offsets)


def documents(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets of these rows) for runs of rows, in order."""
    row = 0
    for data, offsets in buffers(texts):
        for i, j in runs(offsets):
            words, at = hash_words(data, offsets[i : j + 1])
            yield row + i, row + j, words, at
        row += len(offsets) - 1


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, np.array([0, len(data)]))[0][0])


def shingles(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set of hashed runs of ``width`` words, sorted, and the sets' offsets.

    With fewer words, the whole sequence is the one element; without words, the set is empty.
    """
    n = np.diff(at)
    if len(n) == 1 and n[0] >= width:
        key = np.zeros(n[0] - width + 1, np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(3) + words[at[0] + k : at[0] + k + len(key)] + np.uint64(k + 1))
        key = np.unique(key)
        return key, np.array([0, len(key)])
    short = (n > 0) & (n < width)
    count = np.where(n >= width, n - width + 1, short)
    to = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(to[-1]) - to[doc] + at[doc]
    key = np.zeros(len(start), np.uint64)
    spaced = np.concatenate([words, np.zeros(width, np.uint64)])
    left = np.where(short, n, width)[doc]
    for k in range(width):
        key = np.where(k < left, mix(key * np.uint64(3) + spaced[start + k] + np.uint64(k + 1)), key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(n) + 1))
