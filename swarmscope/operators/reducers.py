"""Named and custom reducers, and aggregation on grids of settings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.functions.columns import number

Reducer = str | Callable[[pd.Series], float]
QUANTILES = {"q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def reduce_column(name: str, reducer: Reducer) -> Column:
    """An aggregate; quantiles are exact, with linear interpolation."""
    if callable(reducer):
        from pyspark.sql.functions import pandas_udf

        def custom(x: pd.Series) -> float:
            return reducer(x.dropna())

        custom.__annotations__ = {"x": pd.Series, "return": float}
        return pandas_udf(custom, "double")(F.col(name).cast("double"))
    if reducer in QUANTILES:
        return F.percentile(name, QUANTILES[reducer])
    plain = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    if reducer in plain:
        return plain[reducer](name)
    if reducer == "cv":
        return F.stddev_samp(name) / F.nullif(F.avg(name), F.lit(0.0))
    raise ValueError(f"unknown reducer: {reducer}")


def grid_aggregate(frames: DataFrame, metric: str, reducer: Reducer = "mean") -> DataFrame:
    """One value per placement, xanthan, rpm and aeration; rows missing a key or the metric are left out."""
    keys = ["placement", "xanthan", "rpm_val", "aer_val"]
    name = f"{metric}_agg" if callable(reducer) else f"{metric}_{reducer}"
    known = frames.withColumns({"rpm_val": number(F.col("rpm_val")), "aer_val": number(F.col("aer_val"))}).dropna(subset=[*keys, metric])
    return known.groupBy(*keys).agg(reduce_column(metric, reducer).alias(name))


def setting_reduce(frames: DataFrame, metric: str, reducer: Reducer = "mean") -> DataFrame:
    return frames.groupBy("placement", "reactor_setting").agg(reduce_column(metric, reducer).alias(metric))
