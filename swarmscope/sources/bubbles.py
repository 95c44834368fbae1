"""Scans of stored bubbles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmscope.functions.columns import nan_to_null
from swarmscope.sources.schema import BUBBLE, KEYS, RENAMED

Filter = tuple[str, str, object]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def predicate(item: Filter) -> Column:
    """A (column, operator, value) tuple; operators == != > >= < <= in and not in."""
    name, op, value = item
    c = F.col(name)
    if op in ("in", "not in"):
        found = c.isin(*value)
        return found if op == "in" else ~found
    plain = {"==": c.__eq__, "=": c.__eq__, "!=": c.__ne__, ">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
    if op not in plain:
        raise ValueError(f"unknown operator: {op}")
    return plain[op](value)


def where_all(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """All tuples must hold; they reach the scan as pushed filters. A missing value, NaN or null, meets none."""
    if not filters:
        return df
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    there = [~F.isnan(n) for n in dict.fromkeys(n for n, _, _ in filters if n in floating)]
    return df.where(reduce(and_, [*map(predicate, filters), *there]))


def scan_bubbles(
    spark: SparkSession, path: str, columns: list[str] | None = None, placements: list[str] | None = None, settings: list[str] | None = None,
    filters: list[Filter] | None = None, schema: T.StructType = BUBBLE, keys: list[str] = KEYS, by_file_name: bool = False,
) -> DataFrame:
    """All files below ``path``, NaN as null, pruned to ``columns`` and the keys.

    Placements match whole names; with ``by_file_name``, files whose name holds one of them, so that ``placement_1`` also
    hits ``placement_10``. A filter on a column that was not asked for still holds.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    if placements is not None:
        name = F.col("_metadata.file_name")
        df = df.where(reduce(lambda a, b: a | b, [name.contains(p) for p in placements], F.lit(False))) if by_file_name else df.where(F.col("placement").isin(*placements))
    if settings is not None:
        df = df.where(F.col("reactor_setting").isin(*settings))
    df = where_all(df, filters or [])
    if columns is not None:
        df = require(df, columns).select(*dict.fromkeys([*[k for k in keys if k in df.columns], *columns]))
    return nan_to_null(df)


def scan_placement(spark: SparkSession, path: str, placement: str, columns: list[str] | None = None) -> DataFrame:
    return scan_bubbles(spark, path, columns, [placement])


def bubble_table(df: DataFrame) -> DataFrame:
    """The bubble-level table: analysis names, and all keys present."""
    return require(df.withColumnsRenamed(RENAMED), KEYS)
