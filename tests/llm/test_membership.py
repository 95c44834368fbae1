from __future__ import annotations

import pytest

from swarmscope.llm.membership import parted


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 13, 1 << 10, 64])
@pytest.mark.parametrize("every", [1, 2, 7, 10**9])
def test_parted_equals_sets(spark, most_bits, every):
    """Filters of all sizes: most_bits of 1 << 13 lets many unlisted keys pass, 64 tells nothing at all."""
    keys = [(i, i * i % 101) for i in range(2000)]
    listed, unlisted = ([k for k in keys if (k[0] % every == 0 and k[0] > 0) is yes] for yes in (True, False))
    rows = [(a, b, a, "x") for a, b in keys] + [(4, 16, -1, "again"), (None, 16, 0, "y"), (4, None, 0, "y"), (None, None, 0, "z")]
    docs = spark.createDataFrame(rows, "a long, b long, told long, key_0 string").repartition(3)
    frames = (spark.createDataFrame(k, "p long, q long") for k in (listed, unlisted))
    out, inside = parted(docs, [docs["a"], docs["b"]], *frames, most_bits=most_bits)
    assert out.columns == inside.columns == docs.columns
    chosen = set(listed)
    order = lambda some: sorted(map(tuple, some), key=str)
    assert order(out.collect()) == order(r for r in rows if r[:2] not in chosen)
    assert order(inside.collect()) == order(r for r in rows if r[:2] in chosen)
