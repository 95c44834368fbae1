"""Roll-ups of bubbles: by setting and by frame, and the densities derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.functions.calibration import DEFAULT, Calibration
from swarmscope.functions.columns import ratio
from swarmscope.functions.settings import SPHERE_LIKE

SETTING_KEYS = ["placement", "reactor_setting"]
FRAME_KEYS = ["placement", "reactor_setting", "replicate", "burst_index", "image_number_in_burst"]
MEASURES = {"volume": "bubble_volume_mm3", "surface": "bubble_surface_area_mm2", "diameter": "equivalent_diameter_mm", "kind": "model_used"}


def _sum(x: Column) -> Column:
    """0 where nothing is there to sum."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def _known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def setting_rollup(bubbles: DataFrame, keys: list[str] = SETTING_KEYS, columns: dict[str, str] = MEASURES) -> DataFrame:
    """Sums and counts in one pass; the sphere-like subset by conditional aggregates, not by a second scan or a join."""
    v, a, d = (F.col(columns[k]) for k in ("volume", "surface", "diameter"))
    sphere = F.col(columns["kind"]).isin(*SPHERE_LIKE)
    return _known_keys(bubbles, keys).groupBy(*keys).agg(
        _sum(v).alias("V_total_mm3"),
        _sum(F.when(sphere, v)).alias("V_sphere_mm3"),
        _sum(a).alias("A_total_mm2"),
        _sum(F.when(sphere, a)).alias("A_sphere_mm2"),
        _sum(d).alias("d_sum_mm"),
        F.count(d).alias("d_count"),
        F.count("*").alias("n_total"),
        F.count(F.when(sphere, 1)).alias("n_sphere"),
    )


def setting_ratios(rollup: DataFrame) -> DataFrame:
    return rollup.withColumns(
        {
            "mean_diameter_mm": ratio("d_sum_mm", "d_count"),
            "frac_sphere_count": ratio("n_sphere", "n_total"),
            "frac_sphere_volume": ratio("V_sphere_mm3", "V_total_mm3"),
            "frac_sphere_surface": ratio("A_sphere_mm2", "A_total_mm2"),
        }
    )


def sphere_left_join(bubbles: DataFrame, keys: list[str] = SETTING_KEYS, columns: dict[str, str] = MEASURES) -> DataFrame:
    """The same totals as a left join of all rows' totals with the sphere-like rows', absent groups as 0."""
    known = _known_keys(bubbles, keys)
    total = known.groupBy(*keys).agg(_sum(F.col(columns["volume"])).alias("V_total_mm3"), F.count("*").alias("n_total"))
    spheres = known.where(F.col(columns["kind"]).isin(*SPHERE_LIKE)).groupBy(*keys)
    part = spheres.agg(_sum(F.col(columns["volume"])).alias("V_sphere_mm3"), F.count("*").alias("n_sphere"))
    return total.join(part, keys, "left").fillna({"V_sphere_mm3": 0.0, "n_sphere": 0})


def frame_rollup(bubbles: DataFrame, keys: list[str] = FRAME_KEYS, columns: dict[str, str] = MEASURES) -> DataFrame:
    out = setting_rollup(bubbles, keys, columns).withColumnsRenamed({"d_sum_mm": "diameter_sum_mm", "d_count": "diameter_count", "n_total": "n_bubbles_total", "n_sphere": "n_bubbles_sphere"})
    return out.withColumns(
        {
            "mean_diameter_mm": ratio("diameter_sum_mm", "diameter_count"),
            "frac_sphere_count": ratio("n_bubbles_sphere", "n_bubbles_total"),
            "frac_sphere_volume": F.expr("try_divide(V_sphere_mm3, V_total_mm3)"),
            "frac_sphere_surface": F.expr("try_divide(A_sphere_mm2, A_total_mm2)"),
        }
    )


def densities(rollup: DataFrame, count: str = "n_total", per_ml: str = "n_per_mL", calibration: Calibration = DEFAULT, depth_mm: float | None = None, volume: str = "V_total_mm3", surface: str = "A_total_mm2") -> DataFrame:
    """Hold-up, interfacial area and number densities over the observed volume and over its liquid."""
    observed = F.lit(calibration.observed_volume_mm3(depth_mm))
    v, a = F.col(volume), F.col(surface)
    out = rollup.withColumns({"V_obs_mm3": observed, "V_obs_mL": observed / 1000.0, "epsilon_obs": v / observed, "a_obs_mm_inv": a / observed})
    out = out.withColumns({"a_obs_m2_m3": F.col("a_obs_mm_inv") * 1000.0, per_ml: F.col(count) / F.col("V_obs_mL"), "a_specific_mm_inv": ratio(a, v), "V_liquid_mm3": F.col("V_obs_mm3") - v})
    out = out.withColumns({"a_specific_m2_m3": F.col("a_specific_mm_inv") * 1000.0, "V_liquid_mL": F.col("V_liquid_mm3") / 1000.0, "a_L_mm_inv": ratio(a, "V_liquid_mm3")})
    return out.withColumn("a_L_m2_m3", F.col("a_L_mm_inv") * 1000.0)


def burst_confidence(bubbles: DataFrame) -> DataFrame:
    return bubbles.groupBy("reactor_setting", "burst_index").agg(F.avg("confidence").alias("mean_confidence"))


def summary(bubbles: DataFrame, value: str = "equivalent_diameter_mm", keys: list[str] = SETTING_KEYS) -> DataFrame:
    return bubbles.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))
