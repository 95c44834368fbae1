"""Token ids as binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, one after the other, and two non-decreasing sequences in Elias-Fano
form: where each document ends, and the documents' ids. Such a sequence of n values up to u takes about
n (2 + log2(u / n)) bits: the low bits of all values packed, the high parts as a bit vector with a one for each value.
Every 512th one's position is kept as a sample, from which select counts on; no table of 64-bit offsets exists.

Layout, little-endian: 8 bytes magic; unsigned 64-bit numbers (ids, bytes of an id, then of either sequence: values,
largest value, low-bit width, sampling step, bytes of low and high bits, samples, bytes of a sample); the first doc_id;
ids; low bits, high bits and samples of either sequence. All sections start at multiples of 8 bytes.

Documents are ordered by id, null ids last, then by the checksum and bytes of their tokens. Files are cut by bytes of text:
a histogram over id ranges is refined where a range is too full, and a single id, or null, that is too full spreads over
several files by checksum, so that only rows equal in id and text must share a file. A null text is an empty text, which
is just its end. A task holds one file's ids, and about 60 bytes for each byte of the longest text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W
from swarmscope.llm.elias_fano import EliasFano
from swarmscope.llm.files import read_bytes, write_arrays, write_bytes
from swarmscope.llm.memory import lean, lean_group
from swarmscope.llm.storage import discard, drop, save, shuffles_end
from swarmscope.llm.stretches import Distinct, Table, hash_stretch, ragged, stretches, unpack_distinct

MAGIC = b"SWTOKEF1"
CELLS = 4096  # ranges of the first histogram
FINER = 4  # bits by which a range that is too full is refined
HELD_BYTES = 8 << 20  # of ids that an encoding task packs at once
SIGN = -(2**63)


def padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def encode_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray) -> list[bytes]:
    """``doc_ids``: sorted signed 64-bit numbers; they are stored by their distance from the first."""
    base = int(doc_ids[0]) if len(doc_ids) else 0
    sequences = [EliasFano.of(np.cumsum(lengths)), EliasFano.of((doc_ids.astype(np.int64) - base).astype(np.uint64))]
    head = [len(ids), ids.itemsize, *sequences[0].header(), *sequences[1].header()]
    parts = [MAGIC, np.array(head, "<u8").tobytes(), np.array([base], "<i8").tobytes(), padded(ids.tobytes())]
    return parts + [padded(x.tobytes()) for s in sequences for x in (s.low, s.high, s.samples)]


class TokenFile:
    """A file's contents, as views of its bytes."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        n_ids, self.id_bytes, *heads = (int(x) for x in np.frombuffer(view, "<u8", 18, 8))
        self.base = int(np.frombuffer(view, "<i8", 1, 152)[0])
        at = 160

        def section(size: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, size, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.ids = section(n_ids, f"<u{self.id_bytes}")
        parts = []
        for n, universe, width, sample, low, high, samples, size in (heads[:8], heads[8:]):
            parts.append(EliasFano(n, universe, width, sample, section(low, "u1"), section(high, "u1"), section(samples, f"<u{size}")))
        self.ends, self.docs = parts
        self.n = self.ends.n

    def document(self, i: int) -> np.ndarray:
        """The ids of document number ``i``, found by select."""
        first = int(self.ends.get(np.array([i - 1]))[0]) if i else 0
        return self.ids[first : int(self.ends.get(np.array([i]))[0])]

    def doc_ids(self) -> np.ndarray:
        return self.docs.all().astype(np.int64) + self.base


class Encoder:
    """Ids of texts by a tokenizer file.

    ``by_space``: make use of it where the tokenizer splits before a single space or line end between two signs that are
    no white space, so that a stretch encodes alone, with the sign before it, as it does in its text. Then each distinct
    stretch of the whole table is encoded once; odd texts are encoded whole.
    """

    def __init__(self, path: str, end: int, by_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end], self.kind)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_space = by_space and len(line) == 1 and splits_by_space(path)
        self.line = np.array(line[:1], self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def stretches(self, some: list[str]) -> list[np.ndarray]:
        """Ids of stretches, those without a line end before them after a space; many at once with line ends between."""
        out: list[np.ndarray] = []
        for k in range(0, len(some), 4096):
            part = some[k : k + 4096]
            ids = self.whole("\n".join([x[1:] if x[0] == "\n" else " " + x for x in part]))
            cuts = np.flatnonzero(ids == self.line[0])
            if len(cuts) == len(part) - 1:
                found = [ids[i:j] for i, j in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
            else:
                found = [self.whole(x[1:] if x[0] == "\n" else " " + x) for x in part]
            out += [np.concatenate([self.line, ids]) if x[0] == "\n" else ids for x, ids in zip(part, found, strict=True)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, table: Table | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, an end after each, and the texts' offsets among them."""
        run = stretches(data, offsets)
        n = len(offsets) - 1
        whole = np.flatnonzero(run.odd if table else np.diff(offsets) > 0)
        rest = {int(k): self.whole(bytes(data[offsets[k] : offsets[k + 1]]).decode()) for k in whole}
        if table:
            first, index, which = np.unique(run.first_hash, return_index=True, return_inverse=True)
            if (run.second_hash != run.second_hash[index][which]).any():
                raise RuntimeError("two stretches of a run share a hash")
            ids, starts, sizes = table.find(first, run.second_hash[index])
            starts, sizes = starts[which], sizes[which]
            heads = run.at[:-1][np.diff(run.at) > 0]
            starts[heads] += 1  # a text does not start with a line end
            sizes[heads] -= 1
            counts = np.diff(run.at)
        else:
            ids, starts, sizes, counts = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
        # after each text's stretches, its ids if it is odd, and its end
        more = [ids.astype(self.kind), *[rest[k] for k in sorted(rest)], self.end]
        at_more = np.cumsum([0, *map(len, more)])
        place = np.full(n, at_more[-2])
        extra_start, extra_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, i in enumerate(sorted(rest)):
            extra_start[i], extra_size[i] = at_more[1 + k], len(rest[i])
        to = np.concatenate([[0], np.cumsum(counts + 2)])
        all_starts, all_sizes = np.zeros(to[-1], np.int64), np.zeros(to[-1], np.int64)
        own = np.arange(len(starts)) + np.repeat(2 * np.arange(n), counts)
        all_starts[own], all_sizes[own] = starts, sizes
        all_starts[to[1:] - 2], all_sizes[to[1:] - 2] = extra_start, extra_size
        all_starts[to[1:] - 1], all_sizes[to[1:] - 1] = place, 1
        out = np.concatenate(more)[ragged(all_starts, all_sizes)]
        return out, np.concatenate([[0], np.cumsum(all_sizes)])[to]


def splits_by_space(path: str) -> bool:
    """Whether the file is of a byte-level BPE that looks at the text by the usual pattern alone."""
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    before = about.get("pre_tokenizer") or {}
    plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or any(map(str.isspace, x["content"]))) for x in about.get("added_tokens") or [])
    return plain and not about.get("normalizer") and about["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


_encoders: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    """One for each worker process, not for each task."""
    if args not in _encoders:
        _encoders.clear()
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def cell(k: int):
    """The number of an id's range, of 2^k ids, in the order of ids."""
    return F.shiftrightunsigned(F.col("doc_id").bitwiseXOR(F.lit(SIGN)), k)


def files_of(sized: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each file, and how many files it takes, for ``sized`` (doc_id, bytes) with no null ids.

    Histograms gather at most CELLS ranges, and 2^FINER for each range that is too full: in all a few for each file.
    """
    low, high = sized.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = 0
    while ((high - SIGN) >> k) - ((low - SIGN) >> k) >= CELLS:
        k += 1
    leaves: list[tuple[int, int]] = []
    rest = sized
    while True:
        counted = [(r["cell"] % (1 << (64 - k)), r["bytes"]) for r in rest.groupBy(cell(k).alias("cell")).agg(F.sum("bytes").alias("bytes")).collect()]
        full = [c for c, n in counted if n > most and k]
        leaves += [(c << k, n) for c, n in counted if n <= most or not k]
        if not full:
            break
        cells = sized.sparkSession.createDataFrame([(c - (1 << 64) if c >= 1 << 63 else c,) for c in full], "cell long")
        rest = rest.join(F.broadcast(cells), cell(k) == F.col("cell"), "left_semi")  # at most one for each file
        k = max(0, k - FINER)
    leaves.sort()
    firsts, parts, held = [], [], most + 1
    for start, n in leaves:
        if held + n > most:
            firsts.append(start + SIGN)
            parts.append(max(1, -(-n // most)))
            held = n if n <= most else most
        else:
            held += n
    return np.array(firsts, np.int64), np.array(parts, np.int64)


def slices(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([ids[:0], *(ids[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist(), strict=True))])


def pack_rows(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    body = np.array([len(doc_ids)], np.int64).tobytes() + doc_ids.tobytes() + lengths.tobytes() + ids.tobytes()
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpack_rows(blob: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.int64, n, 8 + 8 * n), np.frombuffer(body, kind, -1, 8 + 16 * n)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, by_space: bool = True, bytes_per_file: int = 32 << 20, stretches_per_file: int = 1_000_000) -> DataFrame:
    """Write all documents; returns one row per file: file, path, start, n_docs, n_ids, null_ids, in order."""
    spark = docs.sparkSession
    sized = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes")), "token-sizes")
    none = sized.where("doc_id IS NULL").agg(F.sum("bytes")).first()[0] or 0
    firsts, parts = files_of(sized.where("doc_id IS NOT NULL"), bytes_per_file)
    numbers = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)  # of each range's first file, and of null ids'
    parts = np.append(parts, -(-none // bytes_per_file))
    drop(sized)

    table = learn(docs, f"{folder}/_table", tokenizer, end, stretches_per_file) if encoder(tokenizer, end, by_space).by_space else None
    kind = "<u2" if vocabulary(tokenizer, end) <= 1 << 16 else "<u4"

    def packed(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        keys = doc_ids.fill_null(0).to_numpy().astype(np.int64)
        group = np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), len(firsts), np.searchsorted(firsts, keys, side="right") - 1)
        file = numbers[group]
        for i in np.flatnonzero(parts[group] > 1).tolist():
            file[i] += zlib.crc32(ids[at[i] : at[i + 1]].tobytes()) * int(parts[group[i]]) >> 32
        order = np.argsort(file, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(file[order]) > 0, [True]]))
        sizes = np.diff(at)
        made = [pack_rows(keys[some := order[i:j]], sizes[some], slices(ids, at[some], sizes[some])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(file[order][cuts[:-1]].astype(np.int32)), pa.array(made, pa.binary())], ["file", "packed"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end, by_space)
        for batch in batches:
            row = held = 0
            some: list[tuple[np.ndarray, np.ndarray]] = []
            for data, offsets in W.buffers(batch.column(1)):
                for i, j in W.runs(offsets):
                    some.append(own.encode(data, offsets[i : j + 1], table))
                    held += some[-1][0].nbytes
                    if held >= HELD_BYTES or j == len(offsets) - 1:
                        base = np.cumsum([0, *(x[1][-1] for x in some)])
                        at = np.concatenate([[0], *(x[1][1:] + b for x, b in zip(some, base, strict=False))])
                        yield packed(batch.column(0).slice(row, len(at) - 1), np.concatenate([x[0] for x in some]), at)
                        row += len(at) - 1
                        some, held = [], 0

    def written(rows: pa.Table) -> pa.Table:
        file = rows["file"][0].as_py()
        doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*(unpack_rows(b.as_buffer().to_pybytes(), kind) for b in rows["packed"]), strict=True))
        at = np.cumsum(lengths) - lengths
        order = np.argsort(doc_ids, kind="stable")
        same = doc_ids[order][1:] == doc_ids[order][:-1]
        if same.any():
            raw = [ids[i : i + n].tobytes() for i, n in zip(at.tolist(), lengths.tolist(), strict=True)]
            order = np.array(sorted(range(len(raw)), key=lambda i: (doc_ids[i], zlib.crc32(raw[i]), raw[i])))
        path = f"{folder}/part-{file:06d}.tok"
        write_bytes(path, encode_file(slices(ids, at[order], lengths[order]), lengths[order], doc_ids[order]))
        return pa.table({"file": pa.array([file], pa.int32()), "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "null_ids": [file >= numbers[-1]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encoded), "file int, packed binary")
    made = save(rows.groupBy("file").applyInArrow(lean_group(written), "file int, path string, n_docs long, n_ids long, null_ids boolean"), "token-manifest")
    discard(spark, f"{folder}/_table")
    found = sorted(made.collect())  # one row for each file
    drop(made)
    starts = np.cumsum([0, *(r["n_ids"] for r in found)]).tolist()
    return spark.createDataFrame([(r["file"], r["path"], at, r["n_docs"], r["n_ids"], r["null_ids"]) for r, at in zip(found, starts, strict=False)], "file int, path string, start long, n_docs long, n_ids long, null_ids boolean")


def learn(docs: DataFrame, folder: str, tokenizer: str, end: int, stretches_per_file: int) -> Table:
    """Encode each distinct stretch of all texts once, into files of the shared folder."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // 8 // stretches_per_file))
    table = Table(folder, int(buckets))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Distinct(buckets)

        def batch_of(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for data, offsets in W.buffers(batch.column(0)):
                for i, j in W.runs(offsets):
                    found.add(stretches(data, offsets[i : j + 1], both=False))
                    if len(found.held) >= 24:
                        yield batch_of(found.packed())
        yield batch_of(found.packed())

    def encoded(rows: pa.Table) -> pa.Table:
        own = encoder(tokenizer, end, True)
        every: set[str] = set()
        for b in rows["packed"]:
            every.update(unpack_distinct(b.as_buffer()))
        some = sorted(every)
        del every
        ids = own.stretches(some)
        first, second = hash_stretch(some)
        order = np.argsort(first, kind="stable")
        sizes = np.array([len(x) for x in ids], np.int64)[order]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32 if sizes.sum() < 1 << 32 else np.uint64)
        bucket = rows["bucket"][0].as_py()
        write_arrays(table.path(bucket), {"first": first[order], "second": second[order], "starts": starts, "ids": np.concatenate([ids[k] for k in order.tolist()])})
        return pa.table({"bucket": [bucket], "n": [len(some)]})

    with shuffles_end(docs.sparkSession):
        docs.select("text").mapInArrow(lean(distinct), "bucket long, packed binary").groupBy("bucket").applyInArrow(lean_group(encoded), "bucket long, n long").agg(F.sum("n")).collect()
    return table


def vocabulary(tokenizer: str, end: int) -> int:
    with open(tokenizer, encoding="utf-8") as f:
        about = json.load(f)
    return max([end, *about["model"]["vocab"].values(), *[x["id"] for x in about.get("added_tokens", [])]]) + 1


def read(manifest: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, and ids_crc32 over 32-bit ids."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                file = TokenFile(read_bytes(row.path))
                ends = file.ends.get(np.arange(file.n)).astype(np.int64)
                starts = np.concatenate([[0], ends])[:-1]
                crcs = [zlib.crc32(file.ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pd.Series(file.doc_ids(), dtype="Int64").mask(np.full(file.n, bool(row.null_ids)))
                yield pd.DataFrame({"doc_id": doc_ids, "start": row.start + starts, "n_tokens": ends - starts, "ids_crc32": crcs})

    files = manifest.select("path", "start", "null_ids").repartition(max(1, min(manifest.count(), 10_000)), "path")
    return files.mapInPandas(lean(rows), "doc_id long, start long, n_tokens long, ids_crc32 long")
