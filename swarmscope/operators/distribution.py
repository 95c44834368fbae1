"""Histograms, distribution statistics, ranges and highest-density intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """From 0; the last bin is closed; null out of range."""
    place = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return F.when((x >= low) & (x <= high) & (high > low), place)


def histogram(df: DataFrame, value: str, keys: list[str], low: float, high: float, bins: int = 80, relative: bool = False) -> DataFrame:
    """Counts, or shares of the values in range, of the bins that hold any."""
    binned = df.withColumn("bin", bin_of(F.col(value), F.lit(float(low)), F.lit(float(high)), bins)).where("bin IS NOT NULL")
    counted = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    if not relative:
        return counted
    return counted.select(*keys, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("frequency"))


def every_bin(counted: DataFrame, keys: list[str], low: float, high: float, bins: int = 80) -> DataFrame:
    """A ``histogram`` with its edges and with the bins that hold nothing, of each group that holds any."""
    value = next(c for c in counted.columns if c not in (*keys, "bin"))
    width = (float(high) - float(low)) / bins
    grid = counted.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    known = grid.join(counted, [*keys, "bin"], "left")
    return known.select(*keys, "bin", (F.lit(float(low)) + F.col("bin") * width).alias("bin_low"), (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("bin_high"), F.coalesce(F.col(value), F.lit(0)).alias(value))


def distribution_stats(df: DataFrame, value: str, keys: list[str], with_replicate: bool = False) -> DataFrame:
    """Range, mean and number of values, distinct frames, and bubbles a frame.

    Frames are told apart by burst and number; ``with_replicate`` also by replicate, so that pooled ones don't coincide.
    """
    frame = ["burst_index", "image_number_in_burst", *(["replicate"] if with_replicate else [])]
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"), F.count_distinct(*frame).alias("n_frames")
    )
    return out.withColumn("bubbles_per_frame", F.col("n") / F.col("n_frames"))


def global_range(df: DataFrame, value: str, upper: float = 0.995) -> DataFrame:
    return df.agg(F.min(value).alias("low"), F.percentile(value, upper).alias("high"))


def robust_range(df: DataFrame, value: str, keys: list[str], robust: bool = True) -> DataFrame:
    """The 5th and 95th percentiles, or the extremes; widened where they are equal."""
    low, high = (F.percentile(value, 0.05), F.percentile(value, 0.95)) if robust else (F.min(value), F.max(value))
    out = df.groupBy(*keys).agg(low.alias("vmin"), high.alias("vmax"))
    same = F.col("vmin") == F.col("vmax")
    return out.select(*keys, F.when(same, F.col("vmin") - 1e-6).otherwise(F.col("vmin")).alias("vmin"), F.when(same, F.col("vmax") + 1e-6).otherwise(F.col("vmax")).alias("vmax"))


def finite_range(df: DataFrame, value: str) -> DataFrame:
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return df.agg(F.min(finite).alias("vmin"), F.max(finite).alias("vmax"))


def hdi(df: DataFrame, value: str, keys: list[str], mass: float = 0.95) -> DataFrame:
    """The narrowest interval of floor(mass n) steps between sorted values, the first of equals; null where n < 2.

    Ranks are joined with those k later, since the distance differs by group.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    ranked = known.withColumns({"_rank": F.row_number().over(Window.partitionBy(*keys).orderBy("_x")).cast("long"), "_n": F.count("*").over(Window.partitionBy(*keys))})
    ranked = ranked.withColumn("_k", F.floor(F.lit(mass) * F.col("_n")).cast("long"))
    later = ranked.select(*keys, (F.col("_rank") - F.col("_k")).alias("_rank"), F.col("_x").alias("_until")).where("_rank >= 1")
    spans = ranked.join(later, [*keys, "_rank"]).where("_k >= 1 AND _n >= 2")
    best = spans.groupBy(*keys).agg(F.min_by(F.struct("_x", "_until"), F.struct(F.col("_until") - F.col("_x"), "_rank")).alias("_best"))
    groups = known.select(*keys).distinct()
    low, high = F.col("_best._x"), F.col("_best._until")
    return groups.join(best, keys, "left").select(*keys, low.alias("hdi_low"), high.alias("hdi_high"), (high - low).alias("hdi_width"))
