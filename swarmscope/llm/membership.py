"""Rows by whether their key is in a list, with hardly any of them moved.

A broadcast bit filter of bounded size passes all listed keys and few others. A second one holds the unlisted keys that
pass the first. Rows that fail the first are not listed; rows that pass the first and fail the second are listed; only
rows that pass both meet the list in a join. The result is exact at any size: a list too long for the bound of the
filters means that more rows meet it.

Defined results: rows with a null in their key are not listed; repeated rows stay repeated; an empty list lists nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BITS_A_KEY = 12
PLACES = 4
NOT_LISTED, LISTED, UNSURE = 0, 1, 2


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    first = W.mix(keys.view(np.uint64) ^ np.uint64(0x5BD1E9955BD1E995))
    step = W.mix(first) | np.uint64(1)
    return [((first + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PLACES)]


def passes(words: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether keys may be in the filter; one that would tell too little is None and passes all."""
    out = np.ones(len(keys), bool)
    for at in places(keys, len(words) * 64) if words is not None else []:
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def bit_filter(keys: DataFrame, most_bits: int) -> np.ndarray | None:
    """Bits of the keys (one long column), summed up by the executors into words."""
    n = keys.count()
    bits = min(max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()), most_bits)
    if 2 * n > bits:
        return None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(batch.column(0).to_numpy(), bits)))], ["place"])

    words = keys.mapInArrow(placed, "place long").groupBy((F.col("place") / 64).cast("long").alias("word"))
    filled = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def parted(docs: DataFrame, key: list[Column], listed: DataFrame, unlisted: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose key is not in ``listed``, and those whose key is.

    ``key`` are columns of ``docs``, which stand for the columns of ``listed`` and ``unlisted`` in turn; the two hold
    all keys of ``docs`` without a null between them, and each key once.
    """
    spark = docs.sparkSession
    hashed = lambda some: some.select(F.xxhash64(*some.columns).alias("key"))
    one = bit_filter(hashed(listed), most_bits)
    first = spark.sparkContext.broadcast(one)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(first.value, batch.column(0).to_numpy())))

    second = spark.sparkContext.broadcast(None if one is None else bit_filter(hashed(unlisted).mapInArrow(passing, "key long"), most_bits))

    @F.pandas_udf("int")
    def told(keys: pd.Series) -> pd.Series:
        keys = keys.to_numpy(np.int64)
        return pd.Series(np.where(passes(first.value, keys), np.where(passes(second.value, keys), UNSURE, LISTED), NOT_LISTED).astype(np.int32))

    tell, names = unused(docs, "told"), [unused(docs, f"key_{i}") for i in range(len(key))]
    known = docs.withColumns(dict(zip(names, key, strict=True)))
    none = reduce(Column.__or__, (F.col(n).isNull() for n in names))
    known = known.withColumn(tell, F.when(none, NOT_LISTED).otherwise(told(F.xxhash64(*names))))
    unsure = known.where(F.col(tell) == UNSURE)
    theirs = [unused(docs, f"{n}_listed") for n in names]
    met = listed.toDF(*theirs)
    same = [F.col(a) == F.col(b) for a, b in zip(names, theirs, strict=True)]
    out = known.where(F.col(tell) == NOT_LISTED).union(unsure.join(met, same, "left_anti"))
    inside = known.where(F.col(tell) == LISTED).union(unsure.join(met, same, "left_semi"))
    return out.select(docs.columns), inside.select(docs.columns)
