"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows partition i sends to block j is drawn on the driver from the exact multivariate hypergeometric law, one
partition after another, from the room that is left. Each partition orders its rows by a seeded hash and deals the
first to block 0, the next to block 1, and so on; rows are exchanged; each block orders what it got by a second hash.
Every permutation is equally likely, and counts are exact without a retry. A shard is cut into blocks of at most
``block_rows`` rows, so a task's share is bounded at any number of shards; a slot is the block's offset plus the rank.

Law ``rows``: shard sizes differ by one at most. Nulls, repeated rows and ties are rows like others; with fewer rows
than shards some shards are empty; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmscope.llm.storage import save


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n drawn from good + bad, the number of good: inversion over the 40 standard deviations around the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    spread = math.sqrt(max(1.0, n * (good / total) * (bad / total)))
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(low, int(mode - 40 * spread) - 10), min(high, int(mode + 40 * spread) + 10)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), high - low)


def matrix(counts: list[int], room: list[int], seed: int) -> np.ndarray:
    """counts[i] rows of partition i over blocks with room[j]; row and column sums are exact."""
    rng = np.random.default_rng(seed)
    left = list(room)
    out = np.zeros((len(counts), len(room)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            out[i, j] = draw(rng, left[j], rest, n)
            n -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def shard(docs: DataFrame, carried: list[Column], shards: int = 16, seed: int = 7, block_rows: int = 1_000_000) -> DataFrame:
    """``carried`` of every row of ``docs``, plus shard (from 0) and slot (from 0 in each shard, gapless), in place of
    any columns of those names.

    ``carried`` is written once to the shared folder, so that partitions and row positions are data from then on and a
    recomputed task deals its rows as before.
    """
    spark = docs.sparkSession
    rows = save(docs.select(F.struct(*carried).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    parts = sorted(tuple(x) for x in rows.groupBy("part").count().collect())  # one number for each input partition
    total = sum(n for _, n in parts)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    blocks = max(1, -(-max(sizes) // block_rows))
    room = [size * (b + 1) // blocks - size * b // blocks for size in sizes for b in range(blocks)]
    sent = matrix([n for _, n in parts], room, seed)
    schema = T.StructType([T.StructField("to_part", T.IntegerType()), T.StructField("upto", T.ArrayType(T.LongType()))])
    bounds = spark.createDataFrame([(part, x) for (part, _), x in zip(parts, np.cumsum(sent, axis=1).tolist(), strict=True)], schema)

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "part", "at"), "at")
    dealt = rows.withColumn("rank", F.row_number().over(local).cast("long")).join(bounds, F.col("part") == F.col("to_part"))
    block = F.size(F.filter("upto", lambda x: x < F.col("rank")))
    dealt = dealt.select("row", "part", "at", block.alias("block"))
    again = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "part", "at"), "at")
    out = dealt.withColumn("shard", F.expr(f"cast(block div {blocks} AS int)"))
    size = f"({total // shards} + if(shard < {total % shards}, 1, 0))"
    offset = F.expr(f"{size} * (block % {blocks}) div {blocks}").cast("long")
    out = out.withColumn("slot", offset + F.row_number().over(again) - 1)
    names = [c for c in rows.schema["row"].dataType.names if c not in ("shard", "slot")]
    return out.select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")
