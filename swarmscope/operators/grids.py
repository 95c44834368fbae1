"""Grids of settings, lookups and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmscope.functions.settings import preference

#: Metrics shown on grids, with whether their colour range is robust. Fixed values.
GRID_METRICS = {
    "mean_diameter_mm": False, "epsilon_obs": True, "a_obs_m2_m3": True, "frac_sphere_volume": False, "frac_sphere_surface": False,
    "frac_sphere_count": False, "n_bubbles_per_mL": True, "a_specific_m2_m3": True, "a_L_m2_m3": True,
}


def pivot_grid(table: DataFrame, value: str, rpm: list[float], aeration: list[float], keys: list[str]) -> DataFrame:
    """Aeration by rpm with a column for each rpm of the axis, all aerations of the axis present, holes as null."""
    whole = table.select(*keys).distinct().withColumn("aer_val", F.explode(F.array(*[F.lit(float(a)) for a in aeration])))
    levels = [int(r) for r in rpm]
    wide = table.withColumn("rpm_int", F.col("rpm_val").cast("int")).groupBy(*keys, "aer_val").pivot("rpm_int", levels).agg(F.first(value, ignorenulls=True))
    return whole.join(wide, [*keys, "aer_val"], "left").withColumnsRenamed({str(r): f"rpm_{r}" for r in levels})


def xanthan_groups(settings: DataFrame, order: list[str]) -> DataFrame:
    """Per rpm and aeration the concentrations present, in ``order``; those with two or more."""
    ordered = F.array(*[F.lit(x) for x in order])
    found = settings.groupBy("rpm", "aeration").agg(F.collect_set("xanthan").alias("present"))
    levels = F.filter(ordered, lambda x: F.array_contains("present", x))
    return found.select("rpm", "aeration", levels.alias("levels")).where(F.size("levels") >= 2)


def varying_parts(settings: DataFrame) -> DataFrame:
    varies = lambda c: (F.count_distinct(c) > 1).alias(f"{c}_varies")
    return settings.agg(varies("rpm"), varies("aeration"), varies("xanthan"))


def with_meta(values: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with the first meta row of each key."""
    return values.join(meta.dropDuplicates(keys), keys, "left")


def lookup(table: DataFrame, dimension: DataFrame, keys: list[str], value: str, default: str | float) -> DataFrame:
    """Left join with a small dimension, ``default`` where it has no row; the planner broadcasts it by its size."""
    return table.join(dimension, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def mean_ci(df: DataFrame, metric: str, placements: list[str], settings: list[str]) -> DataFrame:
    """Mean and 1.96 standard errors for every pair of the lists; 0 width for one value or none."""
    spark = df.sparkSession
    whole = spark.createDataFrame([(p, s) for p in placements for s in settings], "placement string, reactor_setting string")
    out = df.where(F.col(metric).isNotNull()).groupBy("placement", "reactor_setting").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))
    joined = whole.join(out, ["placement", "reactor_setting"], "left")
    width = F.coalesce(1.96 * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return joined.select("placement", "reactor_setting", "mean", width.alias("ci"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ordered_by_preference(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    return df.orderBy(preference(column, order), column)
