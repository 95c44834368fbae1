"""Small column helpers: missing values, safe ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: str | Column) -> Column:
    """NaN as null."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing measurements as nulls in every floating column, so that aggregates skip them."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floating})


def ratio(a: str | Column, b: str | Column, otherwise: float | None = None) -> Column:
    """a / b where b > 0, else null or ``otherwise``."""
    out = F.when(col(b) > 0, col(a) / col(b))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def number(x: str | Column) -> Column:
    """A double, or null for text that is no number."""
    return F.expr("try_cast({} AS double)".format(x)) if isinstance(x, str) else x.try_cast("double")


def share(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)) / F.count("*")
