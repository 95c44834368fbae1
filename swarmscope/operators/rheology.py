"""Flow curves: power-law seeds, fits and curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_law_seed(points: DataFrame) -> DataFrame:
    """K and n of stress = K rate^n by a line in logarithms; not the least-squares fit, but near it."""
    logs = points.where("shear_rate > 0 AND stress_pa > 0").select("series", F.log("shear_rate").alias("x"), F.log("stress_pa").alias("y"))
    return logs.groupBy("series").agg(F.exp(F.regr_intercept("y", "x")).alias("k"), F.regr_slope("y", "x").alias("n"))


def fit_power_law(x: np.ndarray, y: np.ndarray, start: tuple[float, float] = (0.1, 0.5), rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of y = K x^n: parameters and their covariance."""
    p, damping = np.array(start, float), 1e-3
    model = lambda q: q[0] * x ** q[1]
    cost = float(((y - model(p)) ** 2).sum())
    for _ in range(rounds):
        slopes = np.stack([x ** p[1], p[0] * x ** p[1] * np.log(x)], axis=1)
        square = slopes.T @ slopes
        step = np.linalg.solve(square + damping * np.diag(np.maximum(np.diag(square), 1e-12)), slopes.T @ (y - model(p)))
        with np.errstate(over="ignore", invalid="ignore"):
            new = float(((y - model(p + step)) ** 2).sum())
        if np.isfinite(new) and new <= cost:
            done = np.abs(step).max() <= 1e-12 * (1 + np.abs(p).max())
            p, cost, damping = p + step, new, max(damping / 10, 1e-12)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    slopes = np.stack([x ** p[1], p[0] * x ** p[1] * np.log(x)], axis=1)
    return p, np.linalg.pinv(slopes.T @ slopes) * cost / max(1, len(x) - 2)


def power_law_fit(points: DataFrame) -> DataFrame:
    """series, k, n and their standard errors; series of under two points are left out. A series is a small table."""

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shear_rate", "stress_pa"])
        p, covariance = fit_power_law(rows["shear_rate"].to_numpy(), rows["stress_pa"].to_numpy())
        errors = np.sqrt(np.maximum(np.diag(covariance), 0))
        return pd.DataFrame({"series": [rows["series"].iloc[0]], "k": [p[0]], "n": [p[1]], "k_err": [errors[0]], "n_err": [errors[1]]})

    known = points.where("shear_rate > 0 AND stress_pa IS NOT NULL AND series IS NOT NULL").select("series", "shear_rate", "stress_pa")
    enough = known.groupBy("series").agg(F.count("*").alias("c")).where("c >= 2").select("series")
    return known.join(enough, "series").groupBy("series").applyInPandas(fitted, "series string, k double, n double, k_err double, n_err double")


def power_law_curve(fits: DataFrame, low: float = 0.5, high: float = 340.0, points: int = 500) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    rate = F.lit(low) + F.col("i") * F.lit((high - low) / (points - 1))
    return fits.select("series", "k", "n", i).select("series", "i", rate.alias("shear_rate"), (F.col("k") * F.pow(rate, F.col("n"))).alias("stress_pa"))


def series_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.count("*").alias("n"), F.min("shear_rate").alias("low"), F.max("shear_rate").alias("high"))
