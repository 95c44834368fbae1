"""Texts as stretches between single spaces and line ends, each known by two 64-bit hashes, and a table of their ids.

A stretch counts with the sign before it; a text's first counts as after a line end. Texts with any other white space,
or white space at an end or twice in a row, are odd: a tokenizer may not split them at every space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from swarmscope.llm import words as W
from swarmscope.llm.files import map_arrays

LINE, SPACE = 0x0A, 0x20
BREAK = np.zeros(256, bool)
BREAK[[LINE, SPACE]] = True
OTHER = np.zeros(256, bool)
OTHER[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_random = np.random.Generator(np.random.PCG64(0x7E57))
VALUES = [_random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]


def wide_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII, in UTF-8."""
    at = np.flatnonzero(data >= 0xC2)
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    rest = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return at[two | general | rest]


@dataclass
class Run:
    """Stretches of some texts: hashes, where their bytes are, whether after a line end; and each text's first."""

    first_hash: np.ndarray
    second_hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    data: np.ndarray
    at: np.ndarray  # offsets of texts among stretches; odd and empty texts have none
    odd: np.ndarray  # whether a text is to be encoded whole


def stretches(data: np.ndarray, offsets: np.ndarray, both: bool = True) -> Run:
    """``both``: with the second hash too."""
    first, last = int(offsets[0]), int(offsets[-1])
    data, offsets = data[first:last], offsets - first
    n = len(offsets) - 1
    size = np.diff(offsets)
    inside = ~BREAK[data]
    # a text is odd if its breaks are not all single and inner, or if it has other white space
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~starts_text[:-1] if len(data) else np.zeros(0, bool)
    after = np.concatenate([inside[1:], [False]]) & ~starts_text[1:] if len(data) else np.zeros(0, bool)
    bad = np.flatnonzero((~inside & ~(before & after)) | OTHER[data])
    odd = np.zeros(n, bool)
    for place in (bad, wide_space(data) if len(data) else bad):
        odd[np.searchsorted(offsets, place, side="right") - 1] = True
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    keep = ~odd[owner]
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    line = np.ones(len(starts), bool)
    inner = np.flatnonzero(~starts_text[starts]) if len(starts) else np.zeros(0, np.int64)
    line[inner] = data[starts[inner] - 1] == LINE
    up, down = W.powers(len(data))
    hashes = []
    for values in VALUES[: 1 + both]:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=sums[1:])
        hashes.append(W.mix((sums[ends] - sums[starts]) * down[starts] + (2 * (ends - starts) + line).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return Run(hashes[0], hashes[-1], starts, ends, line, data, np.searchsorted(owner, np.arange(n + 1)), odd & (size > 0))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the stretches from ``starts``, of ``sizes``, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


class Distinct:
    """Distinct stretches of several runs, by first hash."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, run: Run) -> None:
        key, index = np.unique(run.first_hash, return_index=True)
        sizes = run.end[index] - run.start[index]
        self.held.append((key, run.line[index].astype(np.uint8), sizes, run.data[ragged(run.start[index], sizes)]))

    def packed(self) -> list[tuple[int, bytes]]:
        """(bucket, line ends, sizes and bytes), and nothing held any more."""
        if not self.held:
            return []
        keys, line, sizes, data = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        at = np.cumsum(sizes) - sizes
        key, index = np.unique(keys, return_index=True)
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(ends)).tolist():
            some = index[ends[b] : ends[b + 1]]
            head = np.array([len(some)], np.int64).tobytes()
            out.append((b, b"".join([head, line[some].tobytes(), sizes[some].astype(np.uint32).tobytes(), data[ragged(at[some], sizes[some])].tobytes()])))
        return out


def unpack_distinct(blob: pa.Buffer) -> list[str]:
    """The stretches, with a line end before those after one."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    line, sizes = np.frombuffer(blob, np.uint8, n, 8).tolist(), np.frombuffer(blob, np.uint32, n, 8 + n)
    data = memoryview(blob)[8 + 5 * n :]
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
    return [("\n" if k else "") + str(data[i:j], "utf-8") for k, i, j in zip(line, at[:-1], at[1:], strict=True)]


def hash_stretch(stretches_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of stretches as ``unpack_distinct`` gives them."""
    plain = [(x[1:] if x[0] == "\n" else x).encode() for x in stretches_]
    data = np.frombuffer(b"\n".join([(b"" if x[0] == "\n" else b"a ") + p for x, p in zip(stretches_, plain, strict=True)]), np.uint8)
    run = stretches(data, np.array([0, len(data)]))
    # the marks before spaces are stretches too, each just before its own
    own = np.cumsum([1 if x[0] == "\n" else 2 for x in stretches_]) - 1
    return run.first_hash[own], run.second_hash[own]


class Table:
    """Ids of stretches, in files by ranges of their first hash, memory-mapped."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "buckets": self.buckets}

    def path(self, bucket: int) -> str:
        return f"{self.folder}/stretches-{bucket:06d}"

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct first hashes: all their ids in order, and each one's start and size among them."""
        bucket = ((first >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        parts, sizes = [], np.zeros(len(first), np.int64)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            here = slice(ends[b], ends[b + 1])
            t = map_arrays(self.path(b))
            at = np.searchsorted(t["first"], first[here])
            at = np.minimum(at, len(t["first"]) - 1)
            # stretches that share a first hash stand side by side
            while (wrong := (t["second"][at] != second[here]) & (t["first"][np.minimum(at + 1, len(t["first"]) - 1)] == first[here]) & (at + 1 < len(t["first"]))).any():
                at = at + wrong
            if not ((t["first"][at] == first[here]) & (t["second"][at] == second[here])).all():
                raise RuntimeError("a stretch is missing from the table")
            begin = t["starts"][at].astype(np.int64)
            sizes[here] = t["starts"][at + 1] - begin
            parts.append(t["ids"][ragged(begin, sizes[here])])
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        return ids, np.cumsum(sizes) - sizes, sizes
