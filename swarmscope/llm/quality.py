"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed lower-cased words, hashed triples of character classes, and adjacent equal words. A document's vector
is its square-rooted term counts times inverse document frequency, at unit length, projected on the leading singular
directions of the labelled sample and scaled to unit length again. Document frequencies cover all documents. At most
``labelled`` rows, half of each label as far as there are so many, are learnt: rows with the smallest hashes of their
ids. Every document is compared with all of them, in blocks; the ``neighbours`` most similar vote, weighted by a power
of the cosine and by how many labelled rows each stands for.

What is broadcast has a fixed bound: ``labelled`` vectors of ``rank`` numbers, and the projection.

Defined results: a null or empty text scores the share of label 1, as does every text if nothing is labelled 1 or 0
(then 1); label rows with null ids or labels, or for ids that are not in ``docs``, teach nothing; of several rows for
one id the mean is taken, and rows at a half are left out; of several texts for one id the least teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W
from swarmscope.llm.memory import lean

WORD_TERMS, SHAPE_TERMS, REPEAT = 4096, 2047, 6143
TERMS = WORD_TERMS + SHAPE_TERMS + 1
ROWS = 256

#: Character classes: each ASCII sign its own; digits, small and capital letters, and bytes beyond ASCII one each.
CLASS = np.arange(256, dtype=np.int64)
CLASS[ord("0") : ord("9") + 1], CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[128:] = 1, 2, 3, 2


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of counts for each document."""
    n = len(offsets) - 1
    words, at = W.hash_words(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(at))
    codes = [doc * TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64)]
    if len(words) > 1:
        again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
        codes.append(doc[again] * TERMS + REPEAT)
    first, last = int(offsets[0]), int(offsets[-1])
    if last - first > 2:
        c = CLASS[data[first:last]]
        triple = (c[:-2] << 16) + (c[1:-1] << 8) + c[2:]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inner = owner[2:] == owner[:-2]
        codes.append(owner[:-2][inner] * TERMS + WORD_TERMS + (triple[inner] * 0x9E3779B1 >> 7) % SHAPE_TERMS)
    return np.bincount(np.concatenate(codes), minlength=n * TERMS).reshape(n, TERMS)


def blocks(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of consecutive documents, at most ROWS at a time."""
    for data, offsets in W.buffers(texts):
        for i, j in W.runs(offsets):
            for k in range(i, j, ROWS):
                yield term_counts(data, offsets[k : min(j, k + ROWS) + 1])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors, by randomised subspace iteration."""
    start = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    q = start
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


class Voter:
    def __init__(self, idf: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, prior: float, neighbours: int, power: float):
        self.idf, self.projection, self.vectors, self.labels, self.stands_for = idf, projection, vectors, labels, stands_for
        self.prior, self.neighbours, self.power = prior, neighbours, power

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(some) or not len(self.labels):
            return out
        x = unit(weighted(counts[some], self.idf) @ self.projection)
        cosines = x @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 1e-6) ** self.power * self.stands_for[near]
        out[some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality", labelled: int = 3072, rank: int = 64, neighbours: int = 16, power: float = 4.0) -> Voter:
    """``learns``: which label rows may teach, by their doc_id."""
    marks = labels.where(learns & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.avg(label).alias("mark"))
    marks = marks.where("mark <> 0.5").select("doc_id", (F.col("mark") > 0.5).cast("int").alias("mark"), F.xxhash64("doc_id").alias("hash"))
    totals = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    taught = [marks.where(f"mark = {m}").orderBy("hash", "doc_id").limit(labelled // 2) for m in (0, 1)]
    chosen = taught[0].union(taught[1])
    ids = {r["doc_id"]: r["mark"] for r in chosen.collect()}  # at most ``labelled``

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for counts in blocks(batch.column(0)):
                total += (counts > 0).sum(0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(np.append(total, n))], ["term", "n"])

    df = docs.select("text").mapInArrow(lean(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(TERMS + 1)
    n[df["term"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((n[-1] + 1) / (n[:-1] + 1)).astype(np.float32) + np.float32(0.1)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, values = [], []
            for counts in blocks(batch.column(1)):
                for row in counts:
                    at = np.flatnonzero(row)
                    terms.append(at)
                    values.append(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "terms", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    taken = rows.mapInArrow(lean(sparse), "doc_id long, terms array<int>, n array<int>").toPandas().sort_values("doc_id") if ids else None
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 1.0
    if taken is None or not len(taken):
        return Voter(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior, neighbours, power)
    x = np.zeros((len(taken), TERMS), np.float32)
    for i, (at, value) in enumerate(zip(taken["terms"], taken["n"], strict=True)):
        x[i, at] = value
    marked = np.array([ids[d] for d in taken["doc_id"]], np.float64)
    x = weighted(x, idf)
    projection = directions(x, rank)
    shares = np.array([totals.get(m, 0) / max(1, (marked == m).sum()) for m in (0, 1)])
    return Voter(idf, projection, unit(x @ projection), marked, shares[marked.astype(int)], prior, neighbours, power)


def score(docs: DataFrame, voter: Voter, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column``, in place of any column of that name."""
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(voter)
    names = docs.columns
    at = names.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.scores(counts) for counts in blocks(batch.column(at))]
            out = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, column])

    return docs.mapInArrow(lean(scored), docs.select("*", F.lit(0.0).alias(column)).schema)
