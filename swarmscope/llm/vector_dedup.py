"""Near-duplicate vectors by collision-counting projections.

Vectors link if their labels are equal and not null and their cosine is ``least`` or more. Exact copies collapse first.
Unit vectors are projected on ``projections`` random directions. Two that link differ in a projection by a normal
variable of a spread of at most s = sqrt(2 - 2 least); they collide in it if they differ by ``reach`` s or less. A pair
is verified that collides in ``needed`` projections. Verification is exact, in double precision.

The first ``grid`` projections cut space into cells, as wide as the window at which a linking pair is all but certain to
collide; a vector visits, as a query, the cells that its window touches. The window leaves a linking pair out with at most
``GRID_SHARE`` of the chance 1 - ``recall``, in all grid projections together, and ``needed`` is the largest number for
which the chance to be within the window and to collide so often is at least ``recall``, by the binomial law. In a cell, every other
projection is sorted, each query's window is a stretch of it, and collisions of each pair are summed over the stretches.
Cells are cut into chunks of at most about ``chunk`` vectors, met by all their queries, so no label, cell or group of
near copies grows in one task. A chunk returns numbers of links and a spanning forest of what it found, not all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing; a row without an id links with nothing and has a null component; rows equal in label and vector link
with each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, erf, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmscope.llm.ann import matrix, valid
from swarmscope.llm.components import components, forest
from swarmscope.llm.storage import save

GRID_SHARE = 0.25
QUERIES = 128


def needed_collisions(projections: int, reach: float, recall: float) -> int:
    """The largest count that a linking pair reaches with a chance of at least ``recall``."""
    p = erf(reach / sqrt(2))
    chance, k = 0.0, projections
    while k > 0:
        chance += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if chance >= recall:
            return k
        k -= 1
    return 0


def grid_reach(grid: int, recall: float) -> float:
    """The window, in s, that misses a linking pair in any of ``grid`` projections with ``GRID_SHARE`` of 1 - ``recall``."""
    return NormalDist().inv_cdf((1 + (1 - GRID_SHARE * (1 - recall)) ** (1 / grid)) / 2) if grid else 0.0


def linked_pairs(q: np.ndarray, q_at: np.ndarray, x: np.ndarray, x_at: np.ndarray, width: float, needed: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of pairs with enough collisions and a cosine of ``least``; ``*_at``: their sorted-window projections."""
    orders = [np.argsort(x_at[:, k], kind="stable") for k in range(x_at.shape[1])]
    for i in range(0, len(q), QUERIES):
        some = slice(i, min(len(q), i + QUERIES))
        n = some.stop - some.start
        counts = np.zeros(n * len(x), np.int16)
        for k, order in enumerate(orders):
            line = x_at[order, k]
            low = np.searchsorted(line, q_at[some, k] - width, side="left")
            many = np.searchsorted(line, q_at[some, k] + width, side="right") - low
            place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            counts[np.repeat(np.arange(n) * len(x), many) + order[place]] += 1
        a, b = np.divmod(np.flatnonzero(counts >= needed), len(x))
        for j in range(0, len(a), 1 << 16):
            s, t = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
            ok = (q[s] * x[t]).sum(axis=1) >= least
            yield s[ok], t[ok]


def link_vectors(rows: DataFrame, least: float = 0.98, projections: int = 24, reach: float = 2.0, recall: float = 0.999, grid: int = 3, chunk: int = 4096, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spread = sqrt(2 - 2 * least)
    good = valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    marked = save(rows.select("vec_id", "label", F.when(good, F.col("embedding")).alias("embedding")), "vector-rows")
    classes = marked.where("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    classes = save(classes, "vector-classes")
    dims = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    random = np.random.default_rng(seed).standard_normal((dims, projections))
    needed = needed_collisions(projections - grid, reach, recall / (1 - GRID_SHARE * (1 - recall)))
    reached = grid_reach(grid, recall) * spread
    width = 2 * reached

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                x = matrix(some.column(1), dims)
                x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
                at = x @ random
                low, high = np.floor((at[:, :grid] - reached) / width).astype(int), np.floor((at[:, :grid] + reached) / width).astype(int)
                home = np.floor(at[:, :grid] / width).astype(int)
                which, cells, own = [], [], []
                for k, (lo, hi, h) in enumerate(zip(low.tolist(), high.tolist(), home.tolist(), strict=True)):
                    for cell in product(*[range(a, b + 1) for a, b in zip(lo, hi, strict=True)]):
                        which.append(k)
                        cells.append(",".join(map(str, cell)))
                        own.append(list(cell) == h)
                take = pa.array(which, pa.int64())
                vectors = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(2).take(take), some.column(3).take(take), vectors.take(take), pa.array(cells, pa.string()), pa.array(own, pa.bool_())], ["label", "name", "copies", "vector", "cell", "home"])

    schema = f"label {dict(classes.dtypes)['label']}, name long, copies long, vector binary, cell string, home boolean"
    visits = save(classes.select("label", "embedding", "name", "copies").mapInArrow(placed, schema), "vector-visits")
    fill = save(visits.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "vector-fill")
    held = visits.where("home").join(fill, ["label", "cell"]).select("label", "cell", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int").alias("part"), "name", "copies", "vector")
    pieces = fill.select(F.col("label").alias("label"), F.col("cell").alias("cell"), F.col("chunks").alias("pieces"))
    asking = visits.join(pieces, ["label", "cell"]).select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), "name", "copies", "vector")

    def met(key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"name": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(queries) or not len(found):
            return empty
        q, x = (np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(-1, dims) for t in (queries, found))
        (q_name, x_name), copies = (t["name"].to_numpy() for t in (queries, found)), found["copies"].to_numpy()
        links = np.zeros(len(q), np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, t in linked_pairs(q, (q @ random)[:, grid:], x, (x @ random)[:, grid:], reach * spread, needed, least):
            other = q_name[s] != x_name[t]
            s, t = s[other], t[other]
            np.add.at(links, s, copies[t])
            p, r = forest(q_name[s], x_name[t])
            a.append(p)
            b.append(r)
        nodes, roots = forest(np.concatenate(a), np.concatenate(b))
        some = np.flatnonzero(links)
        return pa.table({"name": np.concatenate([q_name[some], nodes]), "links": np.concatenate([links[some], np.zeros(len(nodes), np.int64)]), "root": np.concatenate([q_name[some], roots])})

    results = save(asking.toDF(*asking.columns).groupBy("label", "cell", "part").cogroup(held.groupBy("label", "cell", "part")).applyInArrow(met, "name long, links long, root long"), "vector-links")
    roots = components(results.where("name <> root").select(F.col("name").alias("a"), F.col("root").alias("b")))
    counted = results.groupBy("name").agg(F.sum("links").alias("links"))
    named = classes.join(counted, "name", "left").join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "name").alias("component"))
    found = marked.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
