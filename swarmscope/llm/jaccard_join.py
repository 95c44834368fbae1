"""Exact Jaccard join of word-shingle sets in their metric space.

The distance of two sets is one minus their Jaccard similarity, a metric. With a linking distance e:

1. Documents with equal sets collapse to one set, named by a 64-bit hash.
2. Root regions. Almost all pairs of texts are at distance exactly 1, where no pivot can tell them apart, so the space is
   first cut where distances are 1 or nearly so. Shingles are ordered, frequent ones last; two sets within e share one of
   their first n - ceil(.85 n) + 1 shingles. Most such shingles are in one set only, which a bit filter of bounded size
   leaves out. Sets that share one meet in buckets, with sketches (counts of hashed shingles); sizes, positions and
   sketches tell which may be within e. A bucket, bounded in postings and bytes, returns a spanning forest of that graph,
   never its pairs. Its connected components are the root regions: sets of different ones are farther apart than e.
3. Regions join recursively. A region that is too full for a task gets pivots from its own sets. Each set's distances to
   the pivots, which are more than 2 e apart, are exact. A set within e of a pivot is linked with it. Each set's home is its nearest pivot's region, or,
   if all pivots are at 1 - e or more, the region outside. By the triangle inequality a set at distance d from its own
   pivot can link with members of another pivot's region only if it is within d + 2 e of that pivot, and with those
   outside only if d is at least 1 - 2 e: it is replicated there. Sets linked with one pivot are connected and need no
   comparison with each other, so they spread over any number of tasks. Regions still too full split again by new pivots.
4. Inside a task the same recursion goes on, down to groups that are compared set by set, exactly, and only where sets are
   not connected yet. Tasks return spanning forests. No link between different texts is lost.

Regions that pivots cannot split, because all their sets are within a few e of each other but not of the pivots, are
joined exactly in blocks of bounded size.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than a shingle form one
shingle; rows without a doc_id are returned with a null component; rows that share a doc_id count as one document;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W
from swarmscope.llm.components import components, forest
from swarmscope.llm.memory import lean, lean_group, lean_key, lean_pair
from swarmscope.llm.storage import drop, save, shuffles_end
from swarmscope.llm.stretches import ragged

COUNTS = 64
FREQUENT = 1 << 18  # a shingle is frequent above this part of all shingles, so that fewer than this many are
CELL = 1 << 16  # sets that meet by one shingle in one place
BUCKET_BYTES = 1 << 26  # of a bucket unpacked; a bucket is a task's
POSTED = 1 << 10, 1 << 20  # shingles whose postings are packed together: so many for each bucket, and at most
CROWD = 64  # sets of a cell from which on it is not compared pair by pair
SMALL = 12  # sets of a region inside a task that are compared set by set
PIVOTS = 32  # drawn for a region inside a task, and four times as many wherever they tell too little apart
DRAWN = 1024  # pivots drawn for a region that is split over tasks, at most
LEVELS = 4
FILTER_BITS = 1 << 20, 1 << 28
CELLS = 1 << 21  # cells that a task counts


def name_of(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; of the empty one too."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
    return W.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, words, at in W.documents(texts):
        yield i, j, *W.shingles(words, at, width)


def first_of(names: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether each name is new to this task; what it remembers is bounded."""
    out = np.zeros(len(names), bool)
    for i, x in enumerate(names.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    if len(seen) > 1_000_000:
        seen.clear()
    return out


def at_least(n: np.ndarray, percent: int) -> np.ndarray:
    return (n * percent + 99) // 100


def class_of(n: np.ndarray) -> np.ndarray:
    """0 up to 512 shingles, then one more for each doubling: chance differences between unlike sets shrink with size."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 512)), 0, 8).astype(np.int64)


# root regions


@dataclass
class Order:
    """What is broadcast: frequent shingles, of a bounded number, and how the work is dealt."""

    width: int
    percent: int
    buckets: int
    frequent: np.ndarray  # sorted
    frequency: np.ndarray
    shared: np.ndarray | None = None  # bits: cells of one posting are not in it, and are not posted


def in_filter(cell: np.ndarray, bits: int) -> np.ndarray:
    return (cell & np.uint64(bits - 1)).astype(np.int64)


def described_sets(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows: of every document doc_id, its text's hash, n_shingles and its set's name; of each batch its
    frequent shingles with their counts (n)."""
    columns = ["doc_id", "text_hash", "n_shingles", "name", "shingle", "n"]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, _, keys, at in sets_of(batch.column(2), width):
                names.append(name_of(keys, at))
                sizes.append(np.diff(at))
                parts.append(keys[np.repeat(first_of(names[-1], seen), sizes[-1])])
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names)), none, none], columns)
            keys = np.sort(np.concatenate(parts))
            del parts
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(keys)))
            often = counts > 1 + len(keys) / FREQUENT
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys[heads[often]].view(np.int64)), pa.array(counts[often])], columns)

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(described), "doc_id long, text_hash long, n_shingles long, name long, shingle long, n long"), "shingle-sets")


def bucket_count(sizes: list[tuple[int, int, int]], percent: int, bucket_postings: int, share: float = 1.0) -> int:
    """Buckets that hold at most ``bucket_postings`` and BUCKET_BYTES each, about. ``sizes``: sets, their shingles, and
    the largest, by classes of size; ``share``: of the postings that are posted. The more buckets, the more of them a
    set's sketch goes to, up to one a posting."""
    total = sum(n for _, n, _ in sizes)
    buckets = max(1, -(-int(total * share * (101 - percent)) // 100 // bucket_postings))
    while True:
        full = 0.0
        for sets, n, most in sizes:
            length = share * (n / sets * (101 - percent) / 100 + 1)
            full += sets * (16 * length + min(length, buckets) * (16 + (COUNTS << int(class_of(np.array([most]))[0]))))
        if full <= buckets * BUCKET_BYTES:
            return buckets
        buckets = int(full // BUCKET_BYTES) + 1


def order_of(described: DataFrame, width: int, percent: int, bucket_postings: int, docs: DataFrame | None = None) -> Order:
    """With ``docs``, cells of one posting are left out."""
    by_size = described.where("n_shingles > 0").groupBy(F.floor(F.log2("n_shingles"))).agg(F.count("*"), F.sum("n_shingles"), F.max("n_shingles"))
    sizes = [tuple(r)[1:] for r in by_size.collect()]  # a row for each doubling
    total = sum(n for _, n, _ in sizes)
    common = described.where("n > 0").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > 1 + total / FREQUENT).toPandas()
    common = common.assign(key=common["shingle"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    order = Order(width, percent, 1, common["key"].to_numpy(np.uint64), common["n"].to_numpy(np.int64))
    share = 1.0
    if docs is not None:
        order.shared, share = shared_cells(docs, order, total * (101 - percent) // 100 + 1)
    order.buckets = bucket_count(sizes, percent, bucket_postings, share)
    return order


def cells_of(order: Order, keys: np.ndarray, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each posting's set, its place in the set, and its cell."""
    n = np.diff(at)
    rank = np.zeros(len(keys), np.int64)
    if len(order.frequent) and len(keys):
        place = np.minimum(np.searchsorted(order.frequent, keys), len(order.frequent) - 1)
        rank = np.where(order.frequent[place] == keys, order.frequency[place], 0)
        if rank.any():
            by = np.lexsort((rank, np.repeat(np.arange(len(n)), n)))
            keys, rank = keys[by], rank[by]
    length = np.where(n > 0, n - at_least(n, order.percent) + 1, 0)
    who = np.repeat(np.arange(len(n)), length)
    position = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length)
    key, often = keys[at[:-1][who] + position], rank[at[:-1][who] + position]
    # a shingle of very many sets has places for all pairs of parts of them
    parts = np.maximum(1, -(-often // CELL))
    own = (names[who].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(who)), parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    pair = np.minimum(own[again], other) * (1 << 20) + np.maximum(own[again], other)
    cell = W.mix(key[again] ^ W.mix(pair.astype(np.uint64) + np.uint64(1)))
    return who[again], position[again], cell


def shared_cells(docs: DataFrame, order: Order, about: int) -> tuple[np.ndarray, float]:
    """A bit filter of bounded size that passes all cells of two postings at least, and the share of the postings that
    it passes. Tasks own ranges of its bits; ``about`` so many postings are there."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    bits = min(max(FILTER_BITS[0], 1 << (4 * about).bit_length()), FILTER_BITS[1])
    ranges = 1 << max(0, min((about // CELLS).bit_length(), 14))
    width = bits // ranges

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts = [np.zeros(0, np.uint64)]
            for _, _, keys, at in sets_of(batch.column(0), sent.value.width):
                names = name_of(keys, at)
                new, n = first_of(names, seen), np.diff(at)
                parts.append(cells_of(sent.value, keys[np.repeat(new, n)], np.concatenate([[0], np.cumsum(n[new])]), names[new])[2])
            cell = np.concatenate(parts)
            range_ = in_filter(cell, bits) // width
            by = np.argsort(range_, kind="stable")
            ends = np.searchsorted(range_[by], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([cell[by[ends[k] : ends[k + 1]]].tobytes() for k in some.tolist()], pa.binary())], ["range", "cells"])

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        cells = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows["cells"]]))
        same = cells[1:] == cells[:-1]
        shared = in_filter(cells[1:][same], bits) - key[0].as_py() * width
        there = np.zeros(width, np.uint8)
        there[shared] = 1
        passing = int(there[in_filter(cells, bits) - key[0].as_py() * width].sum())
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary()), "n": [len(cells)], "passing": [passing]})

    rows = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(lean(dealt), "range long, cells binary")
    filter_, n, passing = np.zeros(bits // 8, np.uint8), 1, 0
    with shuffles_end(docs.sparkSession):
        found = rows.groupBy("range").applyInArrow(lean_key(counted), "range long, bits binary, n long, passing long").collect()
    for r in found:
        filter_[r["range"] * width // 8 : (r["range"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
        n, passing = n + r["n"], passing + r["passing"]
    return filter_, passing / n


def postings(order: Order, keys: np.ndarray, at: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed postings and, once each, the sets they are of)."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    # counts by a set's size; 255 stands for 255 and more
    wide = COUNTS << class_of(n)
    wide_at = np.concatenate([[0], np.cumsum(wide)])
    counts = np.bincount(wide_at[doc] + ((keys >> np.uint64(40)).astype(np.int64) & (wide[doc] - 1)), minlength=wide_at[-1])
    counts = np.minimum(counts, 255).astype(np.uint8)
    del doc
    who, position, cell = cells_of(order, keys, at, names)
    if order.shared is not None:
        place = in_filter(cell, 8 * len(order.shared))
        met = (order.shared[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        who, position, cell = who[met], position[met], cell[met]
    bucket = (cell % np.uint64(order.buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(order.buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        mine = by[ends[b] : ends[b + 1]]
        used, local = np.unique(who[mine], return_inverse=True)
        head = np.array([len(used), len(mine)], np.int64)
        body = b"".join(x.tobytes() for x in (head, names[used], n[used].astype(np.int64), cell[mine], local.astype(np.int32), position[mine].astype(np.int32), counts[ragged(wide_at[used], wide[used])]))
        # counts and positions are small numbers: entropy coding halves what is shuffled
        yield b, len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpacked(blob: bytes | pa.Buffer) -> tuple[np.ndarray, ...]:
    blob = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    out, at = [], 16
    for kind, size in ((np.int64, n), (np.int64, n), (np.uint64, m), (np.int32, m), (np.int32, m)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return (*out, np.frombuffer(blob, np.uint8, -1, at))


class Sketches:
    """Counts of many sets, by their width; a set's may be folded to half their width."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.kind = class_of(sizes)
        width = COUNTS << self.kind
        at = np.concatenate([[0], np.cumsum(width)])
        self.row = np.zeros(len(sizes), np.int64)
        self.own: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for c in np.unique(self.kind).tolist():
            some = np.flatnonzero(self.kind == c)
            self.row[some] = np.arange(len(some))
            self.own[c] = flat[ragged(at[some], width[some])].reshape(len(some), -1)
            if c:
                pairs = self.own[c].astype(np.uint16).reshape(len(some), 2, -1)
                folded = pairs.sum(axis=1, dtype=np.uint16)
                folded[(pairs == 255).any(axis=1)] = 65535
                self.half[c] = folded

    def common_at_most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many shingles pairs of sets can have in common."""
        out = np.zeros(len(x), np.int64)
        kinds = self.kind[x] * 64 + self.kind[y]
        for k in np.unique(kinds).tolist():
            some = np.flatnonzero(kinds == k)
            c, d = divmod(k, 64)
            if abs(c - d) > 1:
                out[some] = 2**40
                continue
            low = min(c, d)
            a, b = (((self.own[e] if e == low else self.half[e])[self.row[z[some]]]) for e, z in ((c, x), (d, y)))
            least = np.minimum(a, b)
            full = 255 if low == c == d else 65535
            out[some] = np.where((least >= min(full, 255)).any(axis=1), 2**40, least.sum(axis=1, dtype=np.int64))
        return out


def counts_of(blob: bytes | pa.Buffer, some: np.ndarray) -> np.ndarray:
    """Counts of some of a blob's sets."""
    _, n, *_, counts = unpacked(blob)
    wide = COUNTS << class_of(n)
    return counts[ragged((np.cumsum(wide) - wide)[some], wide[some])]


def may_link(blobs: list[bytes] | list[pa.Buffer], percent: int, step: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """A spanning forest of the pairs that may be linked: two set names each, and the sets' sizes.

    Most cells are of one set. So blobs are unpacked one by one, first without sketches, then once more for the sketches
    of the sets that meet any other.
    """
    parts = [tuple(x.copy() for x in unpacked(b)[:5]) for b in blobs]
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    names, sizes, cells = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    positions = np.concatenate([p[4] for p in parts])
    sets = np.concatenate([p[3].astype(np.int32) + np.int32(b) for p, b in zip(parts, base, strict=False)])
    del parts
    order = np.argsort(cells, kind="stable").astype(np.int32)
    same = cells[order][1:] == cells[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # cells of two sets at least
    nothing = np.zeros(0, np.int64)
    if not len(order):
        return nothing, nothing, nothing, nothing
    meet, sets = np.unique(sets[order], return_inverse=True)
    names, sizes, cells, positions = names[meet], sizes[meet], cells[order], positions[order]
    places = np.searchsorted(meet, base)
    sketches = Sketches(sizes, np.concatenate([counts_of(b, meet[i:j] - low) for b, low, i, j in zip(blobs, base[:-1], places[:-1], places[1:], strict=True) if i < j]))
    order = np.lexsort((names[sets], sizes[sets], cells))
    # equal sets from different tasks count once in a cell
    cell, name = cells[order], names[sets[order]]
    new = np.ones(len(order), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (name[1:] != name[:-1])
    order = order[new]
    sets, positions, cells = sets[order], positions[order].astype(np.int64), cells[order]
    del cell, name, new, order
    heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    many = np.diff(np.append(heads, len(cells)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether postings a and b of one cell are of sets that may be linked."""
        x, y = sets[a], sets[b]
        need = -(-percent * (sizes[x] + sizes[y]) // (100 + percent))
        ok = np.minimum(positions[a], positions[b]) + np.minimum(sizes[x] - positions[a], sizes[y] - positions[b]) >= need
        some = np.flatnonzero(ok)
        for m in range(0, len(some), step):
            s = some[m : m + step]
            ok[s] = sketches.common_at_most(x[s], y[s]) >= need[s]
        return ok

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held
        found.append((names[sets[a]], names[sets[b]]))
        held += len(a)
        if held > 32 * step:
            found[:] = [forest(*(np.concatenate(z) for z in zip(*found, strict=True)))]
            held = len(found[0][0]) // 2

    # crowded cells: each set that is reached meets only those that are not
    for h, m in zip(heads[many > CROWD].tolist(), many[many > CROWD].tolist(), strict=True):
        left, reached = np.arange(h, h + m), []
        while len(left):
            if not reached:
                reached, left = [int(left[0])], left[1:]
            a = reached.pop()
            n = sizes[sets[a]]
            size = sizes[sets[left]]
            near = left[np.searchsorted(size, at_least(n, percent)) : np.searchsorted(size, n * 100 // percent, side="right")]
            hit = near[likely(np.full(len(near), a), near)] if len(near) else near
            if len(hit):
                add(np.full(len(hit), a), hit)
                reached += hit.tolist()
                left = left[~np.isin(left, hit, assume_unique=True)]
    # all others: pairs whose sizes allow a link
    few = np.repeat(many <= CROWD, many)
    own = np.flatnonzero(few)
    group = np.repeat(np.arange(len(heads)), many)[own]
    size = sizes[sets[own]]
    place = (group << np.int64(34)) + size
    until = np.searchsorted(place, (group << np.int64(34)) + size * 100 // percent, side="right")
    partners = until - np.arange(len(own)) - 1
    total = np.cumsum(partners)
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + step, side="right")))
        a = np.repeat(np.arange(i, j), partners[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners[i:j]) - partners[i:j], partners[i:j])
        ok = likely(own[a], own[b])
        add(own[a[ok]], own[b[ok]])
        i = j
    a, b = forest(*(np.concatenate(z) for z in zip(*found, strict=True))) if found else (nothing, nothing)
    by = np.argsort(names, kind="stable")
    size_of = lambda x: sizes[by[np.searchsorted(names, x, sorter=by)]]
    return a, b, size_of(a), size_of(b)


def root_links(docs: DataFrame, order: Order) -> DataFrame:
    """a, b and their sizes: forests whose components are the root regions."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    percent = order.percent

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        # with more buckets more sets are packed together, as each blob has its costs
        enough = min(POSTED[0] * sent.value.buckets, POSTED[1])

        def packed() -> pa.RecordBatch:
            keys, n, names = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            made = list(postings(sent.value, keys, np.concatenate([[0], np.cumsum(n)]), names))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for _, _, keys, at in sets_of(batch.column(0), sent.value.width):
                names = name_of(keys, at)
                new = first_of(names, seen)
                n = np.diff(at)
                held.append((keys[np.repeat(new, n)], n[new], names[new]))
                if sum(len(x[0]) for x in held) >= enough:
                    yield packed()
        if held:
            yield packed()

    def met(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("a", "b", "size_a", "size_b"), may_link([x.as_buffer() for x in rows["packed"]], percent), strict=True)))

    rows = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(lean(posted), "bucket long, packed binary")
    return save(rows.groupBy("bucket").applyInArrow(lean_group(met), "a long, b long, size_a long, size_b long"), "shingle-open")


# the recursive join


@dataclass
class Pivots:
    """Some sets, inverted."""

    keys: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Pivots:
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        return cls(keys, np.append(first, len(every)), np.repeat(np.arange(len(sets)), sizes)[order], sizes)

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of intersections, sets x pivots."""
        out = np.zeros((len(sets), len(self.sizes)), np.int64)
        i = 0
        while i < len(sets):
            j, n = i, 0
            while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 17):
                n += len(sets[j])
                j += 1
            some = np.concatenate(sets[i:j])
            owner = np.repeat(np.arange(i, j), [len(s) for s in sets[i:j]])
            place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == some)
            place, owner = place[hit], owner[hit]
            holds = self.first[place + 1] - self.first[place]
            # in turns, as a shingle may be in every pivot
            total = np.cumsum(holds)
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 20), side="right")))
                code = np.repeat(owner[a:b] - i, holds[a:b]) * len(self.sizes) + self.holders[ragged(self.first[place[a:b]], holds[a:b])]
                out[i:j] += np.bincount(code, minlength=(j - i) * len(self.sizes)).reshape(j - i, -1)
                a = b
            i = j
        return out


@dataclass
class Voronoi:
    """Sets' places among pivots: links to pivots, and (set, region, whether linked with its pivot); region -1 is outside."""

    linked: tuple[np.ndarray, np.ndarray]
    member: np.ndarray
    region: np.ndarray
    tied: np.ndarray


def apart_of(sets: list[np.ndarray], pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """Intersections and unions of sets and pivots."""
    common = pivots.common(sets)
    return common, np.array([len(s) for s in sets], np.int64)[:, None] + pivots.sizes[None] - common


def thinned(pivots: list[np.ndarray], percent: int) -> list[int]:
    """Pivots farther than 2 e from each other: closer ones tell nothing apart, and sets would visit all of them."""
    common, union = apart_of(pivots, Pivots.of(pivots))
    close = 100 * common >= max(1, 2 * percent - 100) * union
    kept: list[int] = []
    gone = np.zeros(len(pivots), bool)
    for i in range(len(pivots)):
        if not gone[i]:
            kept.append(i)
            gone |= close[i]
    return kept


def voronoi(sets: list[np.ndarray], pivots: Pivots, percent: int) -> Voronoi:
    e, sure = 1 - percent / 100, 1e-9
    nothing = np.zeros(0, np.int64)
    parts = [(nothing, nothing, nothing, nothing, np.zeros(0, bool))]  # a block may have no sets
    for i in range(0, len(sets), 512):
        common, union = apart_of(sets[i : i + 512], pivots)
        ball = 100 * common >= percent * union
        apart = 1 - common / np.maximum(union, 1)
        nearest = apart.argmin(axis=1)
        d = apart[np.arange(len(apart)), nearest]
        outside = d >= 1 - e - sure
        # a pivot's members are within 1 - e of it, so that what links with them is below 1
        visits = (apart <= np.where(outside, 2.0, d + 2 * e + sure)[:, None]) & (apart < 1)
        visits[np.arange(len(apart)), nearest] |= ~outside
        member, region = np.nonzero(visits)
        away = np.flatnonzero(outside | (d >= 1 - 2 * e - sure))
        tied = np.concatenate([ball[member, region], np.zeros(len(away), bool)])
        x, p = np.nonzero(ball)
        parts.append((x + i, p, np.concatenate([member, away]) + i, np.concatenate([region, np.full(len(away), -1)]), tied))
    x, p, member, region, tied = (np.concatenate(z) for z in zip(*parts, strict=True))
    return Voronoi((x, p), member, region, tied)


def region_links(sets: list[np.ndarray], tied: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that, with ``tied`` sets connected already, connect all sets within the distance."""
    n = np.array([len(s) for s in sets], np.int64)
    group = np.where(tied, -1, np.arange(len(sets)))  # equal for sets that are connected
    found: list[tuple[int, int]] = []
    unlike: set[tuple[int, int]] = set()

    def link(x: int, y: int) -> None:
        if group[x] != group[y]:
            group[group == group[y]] = group[x]
            found.append((x, y))

    def compare(some: np.ndarray) -> None:
        """Set by set, with those of like size that are not connected with it."""
        some = some[np.argsort(n[some], kind="stable")]
        for k, x in enumerate(some.tolist()):
            rest = some[k + 1 : np.searchsorted(n[some], n[x] * 100 // percent, side="right")]
            for y in rest[group[rest] != group[x]].tolist():
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (n[x] + n[y] - common):
                    link(x, y)

    def meet(some: np.ndarray) -> None:
        """What pivots do not tell apart: sets that are not connected and share one of the shingles that are rarest here."""
        keys = np.concatenate([sets[x] for x in some.tolist()])
        owner = np.repeat(some, n[some])
        _, which, many = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((which, many[which], owner))
        owner, which = owner[order], which[order]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = n[owner]
        place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
        first = place < size - at_least(size, percent) + 1
        owner, which = owner[first], which[first]
        order = np.argsort(which, kind="stable")
        owner, which = owner[order], which[order]
        heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        labels = group[owner]
        mixed = np.flatnonzero(np.minimum.reduceat(labels, heads) != np.maximum.reduceat(labels, heads))
        ends = np.append(heads, len(owner))
        for i, j in zip(ends[mixed].tolist(), ends[mixed + 1].tolist(), strict=True):
            own = owner[i:j]
            for k, x in enumerate(own.tolist()):
                rest = own[k + 1 :]
                for y in rest[(group[rest] != group[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))].tolist():
                    pair = (x, y) if x < y else (y, x)
                    if pair not in unlike and group[x] != group[y]:
                        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * common >= percent * (n[x] + n[y] - common):
                            link(x, y)
                        else:
                            unlike.add(pair)

    def join(some: np.ndarray, pivots: int) -> None:
        if len(some) < 2 or (group[some] == group[some[0]]).all():
            return
        if len(some) <= SMALL:
            return compare(some)
        if pivots >= len(some):
            return meet(some)
        chosen = some[:: -(-len(some) // pivots)]
        chosen = chosen[thinned([sets[x] for x in chosen.tolist()], percent)]
        own = voronoi([sets[x] for x in some.tolist()], Pivots.of([sets[x] for x in chosen.tolist()]), percent)
        for x, p in zip(*own.linked, strict=True):
            link(int(some[x]), int(chosen[p]))
        if len(own.member) > 2 * len(some):
            return meet(some)  # too many at borders
        order = np.argsort(own.region, kind="stable")
        ends = np.searchsorted(own.region[order], np.arange(-1, len(chosen) + 1))
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            inner = some[own.member[order[i:j]]]
            join(inner, pivots if len(inner) < 0.5 * len(some) else 4 * pivots)

    join(np.arange(len(sets)), PIVOTS)
    ends = np.array(found, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def read_sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(k.as_buffer(), np.uint64) for k in rows["keys"]]


def joined(rows: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Links within regions. ``rows``: region, name, n, keys, tied; a region's tied sets are connected already.

    Small regions share tasks. Of a larger one, if its sets that are not tied fit a task, the others are dealt over as
    many tasks as they fill, and meet those in each; if not, all pairs of its blocks meet.
    """
    half = max(1, task_shingles // 2)
    about = rows.groupBy("region").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("tied"), 0).otherwise(F.col("n"))).alias("rest"), F.count("*").alias("members"))
    about = save(about.where("members > 1 AND rest > 0").select("region", "total", "rest"), "shingle-regions")
    total = about.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, -(-total // task_shingles))
    blocks = F.ceil(F.when(F.col("rest") <= half, F.col("total") - F.col("rest")).otherwise(F.col("total")) / half).cast("long")
    dealt = rows.join(about, "region").withColumn("blocks", F.greatest(F.lit(1).cast("long"), blocks))
    own = F.pmod(F.xxhash64("name", F.lit(3)), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.transform(every, lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
    places = F.when(F.col("total") <= task_shingles, F.array(F.lit(0).cast("long")))
    places = places.when(F.col("rest") <= half, F.when(F.col("tied"), F.array(own)).otherwise(every)).otherwise(pairs)
    task = F.when(F.col("total") <= task_shingles, F.pmod(F.xxhash64("region"), F.lit(tasks))).otherwise(F.xxhash64("region", "place"))
    dealt = dealt.withColumn("place", F.explode(places)).select(task.alias("task"), "region", "name", "keys", "tied")

    def met(some: pa.Table) -> pa.Table:
        sets, names, regions, tied = read_sets(some), some["name"].to_numpy(), some["region"].to_numpy(), some["tied"].to_numpy()
        order = np.lexsort((names, regions))
        new = np.ones(len(order), bool)
        new[1:] = (regions[order][1:] != regions[order][:-1]) | (names[order][1:] != names[order][:-1])
        order = order[new]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(regions[order]) != 0, [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            own = order[i:j]
            x, y = region_links([sets[k] for k in own.tolist()], tied[own], percent)
            a.append(names[own[x]])
            b.append(names[own[y]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return save(dealt.groupBy("task").applyInArrow(lean_group(met), "a long, b long"), "shingle-links")


def split(rows: DataFrame, percent: int, task_shingles: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Regions too full for a task, split by pivots of their own: links to pivots, and rows of the regions that arise."""
    about = rows.groupBy("region").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    about = save(about.withColumn("blocks", F.ceil(F.col("total") / task_shingles)).withColumn("pivots", F.least(F.lit(DRAWN), F.ceil(8 + F.col("members") / 16))), "shingle-full")
    sized = rows.join(about, "region").withColumn("draw", F.pmod(F.xxhash64("name", F.lit(level)), F.col("members")))
    block = F.pmod(F.xxhash64("name", F.lit(-1)), F.col("blocks"))
    left = sized.select("region", block.alias("block"), "name", "n", "keys")
    right = sized.where("draw < pivots").select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "name", "keys")

    def cut(key: tuple, some: pa.Table, chosen: pa.Table) -> pa.Table:
        region = key[0].as_py()
        names, n = some["name"].to_numpy(), some["n"].to_numpy()
        if len(chosen):
            chosen = chosen.take(pa.array(np.argsort(chosen["name"].to_numpy())))  # the same in every block
            centres = read_sets(chosen)
            kept = thinned(centres, percent)
            own = voronoi(read_sets(some), Pivots.of([centres[k] for k in kept]), percent)
            centres = chosen["name"].to_numpy()[kept]
        else:
            centres, everyone = np.zeros(0, np.int64), np.arange(len(some))
            own = Voronoi((everyone[:0], everyone[:0]), everyone, np.full(len(some), -1), np.zeros(len(some), bool))
        x, p = own.linked
        away = names[x] != centres[p]
        marks = np.append(centres, np.int64(0x0D15))[own.region].view(np.uint64) if len(own.region) else np.zeros(0, np.uint64)
        regions = W.mix(W.mix(marks) ^ np.uint64(region % 2**64) ^ np.uint64(level + 1)).view(np.int64)
        rows = some.select(["name", "n", "keys"]).take(pa.array(own.member))
        made = pa.table({"region": regions, "name": rows["name"], "n": rows["n"], "keys": rows["keys"], "tied": own.tied, "other": pa.nulls(len(rows), pa.int64())})
        links = pa.table({"region": pa.nulls(away.sum(), pa.int64()), "name": names[x][away], "n": n[x][away], "keys": pa.nulls(away.sum(), pa.binary()), "tied": np.ones(away.sum(), bool), "other": centres[p][away]})
        return pa.concat_tables([made, links.cast(made.schema)])

    keys = ["region", "block"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lean_pair(cut), "region long, name long, n long, keys binary, tied boolean, other long")
    out = save(out, "shingle-split")
    drop(about)
    return out.where("other IS NOT NULL").select(F.col("name").alias("a"), F.col("other").alias("b")), out.where("other IS NULL").drop("other")


def linked(rows: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """All links that connect the sets of each region. ``rows``: region, name, n, keys, tied."""
    half = max(1, task_shingles // 2)
    full = rows.groupBy("region").agg(F.sum("n").alias("total")).where(F.col("total") > task_shingles).select("region", F.col("total").alias("before"))
    full = save(full, "shingle-large")
    ready = rows.join(full, "region", "left_anti")
    links, level = None, 0
    add = lambda x: x if links is None else links.union(x)
    rest = rows.join(full, "region", "left_semi")
    while level < LEVELS and not full.isEmpty():
        to_pivots, parts = split(rest, percent, task_shingles, level)
        links = add(to_pivots)
        # a region is done if what is not tied fits a task, or if it has not become much smaller than the largest before
        largest = full.agg(F.max("before")).first()[0]
        sizes = parts.groupBy("region").agg(F.sum("n").alias("before"), F.sum(F.when(F.col("tied"), 0).otherwise(F.col("n"))).alias("loose"))
        full = save(sizes.where((F.col("loose") > half) & (F.col("before") > task_shingles) & (F.col("before") < 0.8 * largest)).select("region", "before"), "shingle-large")
        links = add(joined(parts.join(full, "region", "left_anti"), percent, task_shingles))
        rest = parts.join(full, "region", "left_semi").withColumn("tied", F.lit(False))
        level += 1
    links = add(joined(ready, percent, task_shingles))
    return links if full.isEmpty() else add(joined(rest, percent, task_shingles))


def whole_sets(docs: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """name and keys of the sets of documents whose doc_id is in ``ids``; a bit filter of bounded size lets some others pass."""
    wanted = ids.count()
    bits = min(max(FILTER_BITS[0], 1 << (8 * wanted).bit_length()), FILTER_BITS[1])

    def place(some: pa.Array) -> np.ndarray:
        return (W.mix(some.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0)))], ["place"])

    words = ids.mapInArrow(places, "place long").groupBy((F.col("place") / 64).cast("long").alias("word"))
    filled = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toPandas()
    filter_ = np.zeros(bits // 64, np.int64)
    filter_[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(filter_.view(np.uint64))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0))
            batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for _, _, keys, at in sets_of(batch.column(1), width):
                data = [keys[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name_of(keys, at)), pa.array(data, pa.binary())], ["name", "keys"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(taken), "name long, keys binary")


def classes_of(docs: DataFrame, width: int, percent: int, bucket_postings: int = 1_500_000, task_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component (a number for each component; null without
    shingles or doc_id) and least (the component's least doc_id) of every row of ``docs``."""
    described = described_sets(docs, width)
    classes = described.where("n IS NULL").select("doc_id", "text_hash", "n_shingles", "name")
    open_ = root_links(docs, order_of(described, width, percent, bucket_postings, docs))
    reps = classes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    reps = save(reps, "shingle-names")  # one row for each set
    if not open_.isEmpty():
        nodes = open_.select(F.col("a").alias("name"), F.col("size_a").alias("n")).union(open_.select("b", "size_b")).distinct()
        roots = components(open_.select("a", "b"))
        regions = nodes.join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
        nodes = save(regions.select("name", "n", F.coalesce("root", "name").alias("region")), "shingle-nodes")
        drop(roots)
        found = whole_sets(docs, width, reps.join(nodes, "name", "left_semi").select("least")).join(nodes, "name").dropDuplicates(["name"])
        rows = save(found.select("region", "name", "n", "keys", F.lit(False).alias("tied")), "shingle-wanted")
        roots = components(linked(rows, percent, task_shingles)).select(F.col("node").alias("name"), "root")
        for done in (rows, open_, nodes):
            drop(done)
        both = reps.join(roots, "name").select("root", "least").union(roots.select(F.col("root").alias("name")).distinct().join(reps, "name"))
        least = save(both.groupBy("root").agg(F.min("least").alias("lower")), "shingle-least")
        named = reps.join(roots, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root"))
        reps = save(named.join(least, "root", "left").select("name", F.col("root").alias("component"), F.coalesce("lower", "least").alias("least")), "shingle-components")
    else:
        reps = reps.select("name", F.col("name").alias("component"), "least")
    own = classes.withColumn("name", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("name")))
    return own.join(reps, "name", "left").select("doc_id", "text_hash", "n_shingles", "component", "least")


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, bucket_postings: int = 1_500_000, task_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row of ``docs``."""
    found = classes_of(docs, width, percent, bucket_postings, task_shingles)
    return found.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
