"""Linking pairs far apart in a projection of the grid."""

from __future__ import annotations

import numpy as np

from swarmscope.llm import vector_dedup


def test_pairs_far_apart_in_the_grid_link(spark):
    rng, dims, n = np.random.default_rng(6), 16, 400_000
    random = np.random.default_rng(11).standard_normal((dims, 24))  # link_vectors' own
    x, side = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    apart = np.abs((x - y) @ random) / np.sqrt(2 - 2 * 0.98)
    # beyond 3.5 spreads in the grid, but within the share that the grid may miss, and colliding often enough
    far = (apart[:, :3].max(axis=1) > 3.5) & (apart[:, :3].max(axis=1) < 3.9)
    far &= (apart[:, 3:] <= 2).sum(axis=1) >= vector_dedup.needed_collisions(21, 2.0, 0.999)
    some = np.flatnonzero(far)[:300]
    assert len(some) > 20
    rows = [(2 * i + k, [float(c) for c in v[j]], i) for i, j in enumerate(some) for k, v in enumerate((x, y))]
    out = vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    assert (out["n_links"] == 1).all()
