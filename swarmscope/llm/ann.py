"""Approximate nearest neighbours by cross-polytope hashing.

Largest inner products become smallest angles: a candidate gets one coordinate more, so that all have the largest norm;
a query gets a zero there. Vectors are padded to a power of two and turned by pseudo-rotations (three rounds of random
signs and a fast Hadamard transform); a table's bucket is the nearest signed axis. A query probes, in every table, the
buckets of its ``probes`` best axes. Every bucket is cut into chunks of at most about ``chunk`` vectors, each met by all
queries that probe the bucket, in blocks; a chunk keeps a query's ``k`` best by exact inner products of the original
vectors in double precision, ties to the smaller id, and a query's chunks are merged. Buckets have no cap.

Queries with fewer than ``k`` found are searched again in all buckets of one table, which is exact.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id; a row is no neighbour of rows with its own id; vectors of differing lengths are padded with zeros; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm.storage import save


def valid(column: str = "embedding") -> Column:
    """Whether a vector is of use."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Signs and Hadamard transforms in turn; the last axis is a power of two."""
    n = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        x /= np.sqrt(n)
    return x


def axes(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """For each table, the signed axes nearest to each vector: tables x vectors x probes, nearest first."""
    out = []
    for s in signs:
        turned = rotate(x, s)
        both = np.concatenate([turned, -turned], axis=1)
        probes = min(probes, both.shape[1])
        best = np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes > 1 else both.argmax(axis=1)[:, None]
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable"), 1))
    return np.array(out)


def matrix(vectors: pa.Array | pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        v = np.asarray(v if not isinstance(v, pa.Scalar) else v.values, np.float64)
        out[i, : len(v)] = v
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's ``k`` best rows: ids and scores; a score depends on the two vectors alone."""
    out = []
    for i in range(0, len(queries), 256):
        rough = queries[i : i + 256] @ rows.T
        rough[query_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        for q, r in zip(queries[i : i + 256], rough, strict=True):
            if len(r) > k:
                least = np.partition(r, len(r) - k)[len(r) - k]
                near = np.flatnonzero(r >= least - 1e-9 * max(1.0, abs(least)))
            else:
                near = np.arange(len(r))
            near = near[r[near] > -np.inf]
            scores = (rows[near] * q).sum(axis=1)
            order = np.lexsort((ids[near], -scores))
            order = order[np.concatenate([[True], ids[near][order][1:] != ids[near][order][:-1]])] if len(order) else order
            out.append((ids[near][order[:k]], scores[order[:k]]))
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 20, tables: int = 8, probes: int = 16, chunk: int = 4096, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of (vec_id, embedding) for which ``is_query`` holds, against all rows."""
    rows = rows.where(F.col("vec_id").isNotNull() & valid()).select("vec_id", "embedding", is_query.alias("asks"))
    about = rows.agg(F.max(F.size("embedding")).alias("dims"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")).first()
    dims, norm = about["dims"] or 1, about["norm"] or 1.0
    padded = 1 << int(dims).bit_length()  # room for one coordinate more
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, padded)).astype(np.float32)

    def lifted(x: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), padded), np.float32)
        out[:, :dims] = x
        out[:, dims] = last
        return out

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                some = batch.slice(i, 2048)
                x = matrix(some.column(1), dims)
                codes = axes(lifted(x, np.sqrt(np.maximum(0.0, norm - (x * x).sum(axis=1)))), signs, 1)[:, :, 0]
                buckets = (np.arange(tables)[:, None] * 2 * padded + codes).T
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(buckets.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "vector", "buckets"])

    def asked(every: bool):
        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 2048):
                    some = batch.slice(i, 2048)
                    x = matrix(some.column(1), dims)
                    if every:
                        buckets = np.tile(np.arange(2 * padded), (len(x), 1))
                    else:
                        codes = axes(lifted(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.zeros(len(x))), signs, probes)
                        buckets = (np.arange(tables)[:, None, None] * 2 * padded + codes).transpose(1, 0, 2).reshape(len(x), -1)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(buckets.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "vector", "buckets"])

        return probed

    kept = save(rows.select("vec_id", "embedding").mapInArrow(stored, "id long, vector binary, buckets array<int>"), "ann-rows")
    # chunks of each bucket: a bounded table, tables x axes
    fill = kept.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    fill = save(fill, "ann-fill")
    held = kept.select("id", "vector", F.explode("buckets").alias("bucket")).join(F.broadcast(fill), "bucket")
    held = held.select("id", "vector", "bucket", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("part"))
    pieces = fill.select(F.col("bucket").alias("bucket"), F.col("chunks").alias("pieces"))

    def met(key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(-1, dims), t["id"].to_numpy()

        if not len(queries) or not len(found):
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        q, q_ids = read(queries)
        x, x_ids = read(found)
        pairs = best(q, q_ids, x, x_ids, k)
        return pa.table({"query_id": q_ids, "ids": pa.array([p[0] for p in pairs], pa.list_(pa.int64())), "scores": pa.array([p[1] for p in pairs], pa.list_(pa.float64()))})

    def search(queries: DataFrame, every: bool, among: DataFrame) -> DataFrame:
        probing = queries.mapInArrow(asked(every), "id long, vector binary, buckets array<int>").select("id", "vector", F.explode("buckets").alias("bucket"))
        probing = probing.join(F.broadcast(pieces), "bucket").select("id", "vector", "bucket", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
        some = probing.groupBy("bucket", "part").cogroup(among.groupBy("bucket", "part")).applyInArrow(met, "query_id long, ids array<long>, scores array<double>")
        pairs = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("far"), p["ids"].alias("id")))
        flat = some.withColumn("pairs", pairs).groupBy("query_id").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
        return flat.select("query_id", F.slice(F.array_sort(F.array_distinct("pairs")), 1, k).alias("pairs"))

    questions = rows.where("asks").select("vec_id", "embedding")
    first = save(search(questions, False, held), "ann-found")
    short = questions.join(first.where(F.size("pairs") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    again = search(short, True, held.where(F.col("bucket") < 2 * padded)) if not short.isEmpty() else None
    found = first if again is None else first.where(F.size("pairs") >= k).union(again)
    return found.select("query_id", F.posexplode("pairs").alias("at", "pair")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("pair.id").alias("vec_id"), (-F.col("pair.far")).alias("score")
    )
