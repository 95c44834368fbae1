"""Shape formulas as columns: spheres, split ellipsoids, model choice, boxes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from swarmscope.functions.columns import col


def equivalent_diameter(area: str | Column) -> Column:
    """Of a disc of that area."""
    return F.when(col(area) > 0, 2 * F.sqrt(col(area) / pi))


def sphere_volume(d: str | Column) -> Column:
    return F.lit(pi / 6) * col(d) * col(d) * col(d)


def sphere_surface(d: str | Column) -> Column:
    return F.lit(pi) * col(d) * col(d)


def half_spheroid_surface(half_axis: Column, b: Column) -> Column:
    """Of the half with semi-axis ``half_axis`` along the axis and ``b`` across, without its base."""
    e = F.sqrt(F.greatest(F.lit(0.0), 1 - (b * b) / (half_axis * half_axis)))
    bend = F.when(b >= half_axis * (1 - 1e-12), 1 + half_axis / b).otherwise(1 + half_axis / (b * e) * F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), e))))
    return F.when((b > 0) & (half_axis > 0), F.lit(pi) * b * b * bend).otherwise(F.lit(0.0))


def ellipsoid_volume(a: str | Column, b1: str | Column, b2: str | Column, true_volume: bool = False) -> Column:
    """Of two half spheroids on the full axis ``a``. The established figure takes half of the true volume for semi-axes."""
    plain = F.lit(pi / 6) * col(a) * (col(b1) * col(b1) + col(b2) * col(b2))
    return plain * 2 if true_volume else plain


def ellipsoid_surface(a: str | Column, b1: str | Column, b2: str | Column) -> Column:
    half = col(a) / 2
    return half_spheroid_surface(half, col(b1)) + half_spheroid_surface(half, col(b2))


def volume_diameter(volume: str | Column) -> Column:
    """Of the sphere with that volume."""
    return F.when(col(volume) > 0, F.cbrt(6 * col(volume) / pi))


def aspect(x: str | Column, y: str | Column) -> Column:
    return F.when((col(x) > 0) & (col(y) > 0), F.greatest(col(x), col(y)) / F.least(col(x), col(y)))


def aspect_delta(x: str | Column, y: str | Column) -> Column:
    return F.when((col(x) > 0) & (col(y) > 0), F.abs(col(x) - col(y)) / F.greatest(col(x), col(y)))


def near_unity(x: str | Column, y: str | Column, tolerance: float = 0.10) -> Column:
    return F.coalesce(aspect(x, y) <= 1 + tolerance, F.lit(False))


def model_choice(eq_px: Column, near: Column, d_sphere: Column, has_fit: Column, mode: str = "hybrid", cutoff_px: float = 100.0) -> Column:
    """sphere, asym_ellipsoid or sphere_fallback. Small or nearly round shapes are spheres in hybrid mode."""
    if mode == "sphere_only":
        return F.lit("sphere")
    fitted = F.when(has_fit, "asym_ellipsoid").otherwise("sphere_fallback")
    if mode == "ellipsoid_only":
        return fitted
    return F.when((eq_px <= cutoff_px) | (near & d_sphere.isNotNull()), "sphere").otherwise(fitted)


def box_iou(p: dict[str, Column], g: dict[str, Column]) -> Column:
    """Of boxes given as x1, y1, x2, y2; 0 if they are disjoint or have no area."""
    w = F.greatest(F.lit(0.0), F.least(p["x2"], g["x2"]) - F.greatest(p["x1"], g["x1"]))
    h = F.greatest(F.lit(0.0), F.least(p["y2"], g["y2"]) - F.greatest(p["y1"], g["y1"]))
    both = w * h
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = area(p) + area(g) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def half_ellipse(cx: Column, cy: Column, half_axis: Column, b: Column, angle: Column, points: int = 200) -> Column:
    """A polyline: array of x, y."""
    turn = F.sequence(F.lit(0), F.lit(points - 1))
    c, s = F.cos(angle), F.sin(angle)

    def at(i: Column) -> Column:
        t = i * pi / (points - 1) - pi / 2
        u, v = half_axis * F.cos(t), b * F.sin(t)
        return F.struct((cx + u * c - v * s).alias("x"), (cy + u * s + v * c).alias("y"))

    return F.transform(turn, at)
